"""Text functions as columns: ids and hashes, cleaning, sentences, structure, quality, patterns, language."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
BOILERPLATE = (r"cookie policy", r"privacy policy", r"terms of service", r"© \d{4}.*?\.", r"all rights reserved", r"powered by.*?\.")
ADS = ("advertisement", "sponsored", "promoted", "click here", "buy now", "sign up", "subscribe")
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "inc", "ltd", "corp", "co", "usa", "uk", "ca", "ny", "la", "sf", "dc", "etc", "vs", "st", "ave",
    "blvd", "rd", "apt", "ste", "no", "vol", "pp", "ed", "rev", "gen", "adm", "capt", "lt", "sgt", "maj", "col", "cmdr", "gov", "sen", "rep",
)
PATTERNS = {
    "emails": ((r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",), 0.99),
    "phone_numbers": ((r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",), 0.95),
    "urls": ((r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?",), 0.98),
    "dates": ((r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b"), 0.9),
    "prices": ((r"\$[\d,]+(?:\.\d{2})?",), 0.95),
    "percentages": ((r"\d+(?:\.\d+)?%",), 0.95),
}
# End of the fixed values.

STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "are"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "auf"),
    "fr": ("le", "la", "les", "et", "est", "des", "une", "dans", "pour", "que", "par", "sur"),
    "es": ("el", "los", "las", "y", "es", "una", "para", "que", "con", "por", "del", "se"),
}


def _re(pattern: str, *, ignore_case: bool = False) -> str:
    """As a Java pattern with Unicode classes, where a dot stops at \\n alone."""
    return f"(?{'iu' if ignore_case else ''}Ud){pattern}"


def _with(c: Column, make: Callable[[Column], Column]) -> Column:
    """`make` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(c), make), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends; texts that have none there are not searched."""
    edges = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    return _with(c, lambda x: F.when(edges(x).rlike(_re(r"\s")), F.regexp_replace(x, _re(r"^\s+|\s+$"), "")).otherwise(x))


def word_count(c: Column) -> Column:
    """Words between white space of any kind."""
    return F.regexp_count(c, F.lit(_re(r"\S+")))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, _re(r"\s+")), "")


def content_id(url: Column, title: Column) -> Column:
    """T1."""
    return F.md5(F.concat(url, F.lit("|"), F.coalesce(F.nullif(title, F.lit("")), F.lit("no-title"))))


def content_hash(text: Column) -> Column:
    """Over lower case and single spaces; neither case nor spacing matters."""
    return F.sha2(F.regexp_replace(F.lower(strip(text)), _re(r"\s+"), " "), 256)


def text_fingerprint(text: Column) -> Column:
    """Without punctuation; empty stays empty."""
    plain = strip(F.regexp_replace(F.regexp_replace(F.lower(text), _re(r"\s+"), " "), _re(r"[^\w\s]"), ""))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.md5(plain))


def structure_fingerprint(paragraphs: Column, sentences: Column, n_words: Column) -> Column:
    """T5."""
    return F.md5(F.format_string("p%d_s%d_w%d", paragraphs.cast("long"), sentences.cast("long"), n_words.cast("long")))


def metadata_fingerprint(items: Column) -> Column:
    """Of a map, by its sorted items."""
    return F.md5(F.to_json(F.array_sort(F.map_entries(items))))


def cache_key(**parts: Column) -> Column:
    """md5 of the named parts in the order of their names."""
    return F.md5(F.concat_ws(":", *[F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit(""))) for k, c in sorted(parts.items())]))


def remove_ads(text: Column) -> Column:
    """T19."""
    return reduce(lambda c, p: F.regexp_replace(c, f"(?i){p}", ""), ADS, text)


def normalise_lines(text: Column) -> Column:
    """Single spaces, at most one blank line, lines stripped."""
    out = F.regexp_replace(F.regexp_replace(text, " +", " "), _re(r"\n\s*\n\s*\n+"), "\n\n")
    return F.array_join(F.transform(F.split(out, "\n"), strip), "\n")


def drop_repeated_lines(text: Column) -> Column:
    """Of equal lines in a row, one."""
    lines = F.split(text, "\n")
    pairs = F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit(None).cast("string")), lines).alias("before"))
    kept = F.filter(F.slice(pairs, F.lit(1), F.size(lines)), lambda x: x["before"].isNull() | (x["line"] != x["before"]))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def truncate(text: Column, most_bytes: int) -> Column:
    """Text of too many bytes keeps a quarter of that in characters, and a marker."""
    return F.when(F.octet_length(text) > most_bytes, F.concat(F.substr(text, F.lit(1), F.lit(most_bytes // 4)), F.lit("... [Content truncated]"))).otherwise(text)


def truncate_bytes(text: Column, most_bytes: int) -> Column:
    """T22, by bytes: a character that the cut would split is left out."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, max(0, most_bytes - 1000)).cast("string"))
    return F.when(F.octet_length(text) > most_bytes, F.regexp_replace(cut, "�$", "")).otherwise(text)


def clean_extracted(text: Column, most_bytes: int = 100_000) -> Column:
    """H6: ads, white space, repeated lines, length."""
    return strip(truncate(drop_repeated_lines(normalise_lines(remove_ads(F.coalesce(text, F.lit(""))))), most_bytes))


def split_sentences(text: Column) -> Column:
    """Stripped sentences; a piece that is an abbreviation alone goes to the one before."""
    pieces = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), strip), lambda s: s != "")
    short = lambda s: F.lower(s).isin(*ABBREVIATIONS)
    start = F.array().cast("array<string>")

    def join(done: Column, piece: Column) -> Column:
        last = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", F.element_at(done, -1), piece)))
        return F.when(short(piece) & (F.size(done) > 0), last).otherwise(F.array_append(done, piece))

    return _with(pieces, lambda ps: F.when(F.exists(ps, short), F.aggregate(ps, start, join)).otherwise(ps))


def dedup_sentences(text: Column) -> Column:
    """Each sentence once; they keep their full stops and are joined by another."""
    return F.array_join(F.array_distinct(split_sentences(text)), ". ")


BRACKETS = {"square_brackets": r"\[.*?\]", "curly_brackets": r"\{.*?\}", "html_tags": r"<.*?>"}
#: What each match of a boilerplate pattern holds in lower case, and letters beyond a-z that match some of a-z in any case.
_MARKS, _FOLDED = ("cookie policy", "privacy policy", "terms of service", "© ", "all rights reserved", "powered by"), "\u017f\u212a\u0131\u0130"


def _any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def without_boilerplate(text: Column) -> Column:
    """T7, first part: newlines, runs of blanks, blank lines, boilerplate; texts without its marks are not searched for it."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, r"(?: [ \t]|\t)[ \t]*", " "), _re(r"\n\s*\n\s*\n+"), "\n\n")
    marked = lambda c: _with(F.lower(c), lambda low: _any(low, _MARKS)) | _any(c, _FOLDED)
    removed = lambda c: reduce(lambda c, p: F.regexp_replace(c, _re(p, ignore_case=True), ""), BOILERPLATE, c)
    return _with(out, lambda c: F.when(marked(c), removed(c)).otherwise(c))


def bracket_counts(text: Column) -> dict[str, Column]:
    """What each bracket pattern removes, in the order of removal."""
    out = {}
    for name, pattern in BRACKETS.items():
        out[f"{name}_removed"] = F.when(text.isNotNull(), F.when(F.contains(text, F.lit(pattern.strip("\\")[0])), F.regexp_count(text, F.lit(_re(pattern)))).otherwise(0))
        text = _without_brackets(text, pattern)
    return out


def _without_brackets(text: Column, pattern: str) -> Column:
    """Texts without the opening bracket are not searched."""
    return _with(text, lambda c: F.when(F.contains(c, F.lit(pattern.strip("\\")[0])), F.regexp_replace(c, _re(pattern), "")).otherwise(c))


def plain_quotes(text: Column) -> Column:
    """Curly quotes and dashes as ASCII."""
    return F.replace(F.translate(text, "“”‘’–", "\"\"''-"), F.lit("—"), F.lit("--"))


def clean_text(text: Column, square: bool = True, curly: bool = True, tags: bool = True, sentences: bool = True) -> Column:
    """T7."""
    return clean_rest(without_boilerplate(text), square, curly, tags, sentences)


def clean_rest(out: Column, square: bool = True, curly: bool = True, tags: bool = True, sentences: bool = True) -> Column:
    """T7, after `without_boilerplate`."""
    for on, pattern in zip((square, curly, tags), BRACKETS.values(), strict=True):
        out = _without_brackets(out, pattern) if on else out
    return strip(plain_quotes(dedup_sentences(out) if sentences else out))


def structure(text: Column) -> dict[str, Column]:
    """Counts of paragraphs, sentences, words, headings and list items, and minutes to read."""
    full = lambda parts: F.size(F.filter(parts, lambda p: p.rlike(_re(r"\S"))))
    lines = F.transform(F.split(text, "\n"), strip)
    heading = lambda x: (x != "") & (x.endswith(":") | ((word_count(x) <= 8) & (F.upper(x) == x) & (F.lower(x) != x)))
    item = lambda x: x.rlike(_re(r"^(?:[\-*•]|\d+\.)\s+"))
    n = word_count(text)
    return {
        "paragraphs": full(F.split(text, "\n\n")), "sentences": full(F.split(text, r"\.")), "words": n, "headings": F.size(F.filter(lines, heading)),
        "list_items": F.size(F.filter(lines, item)), "reading_minutes": F.greatest(F.lit(1), F.floor(n / 200).cast("int")),
    }


def quality_metrics(text: Column) -> dict[str, Column]:
    """Readability, information density and coherence, 0 for a text without a sentence."""
    parts = structure(text)
    sentences, n = parts["sentences"], parts["words"]
    mean = word_count(F.replace(text, F.lit("."), F.lit(" "))) / sentences
    readability = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - (mean - F.lit(10.0)) / F.lit(30.0)))
    density = F.size(F.array_distinct(words(F.lower(text)))) / F.greatest(F.lit(1), n)
    coherence = F.least(F.lit(1.0), parts["paragraphs"] / F.greatest(F.lit(1.0), sentences / F.lit(3.0)))
    return {k: F.when(sentences > 0, c).otherwise(0.0) for k, c in (("readability", readability), ("information_density", density), ("coherence", coherence))}


def cleaning_quality(original: Column, readability: Column, density: Column, coherence: Column) -> Column:
    """Seven parts the given score, three parts the text's own."""
    own = F.lit(0.3) * readability + F.lit(0.4) * density + F.lit(0.3) * coherence
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.7) * original + F.lit(0.3) * own)), 3)


def removed_repeats(text: Column) -> Column:
    """Pieces between full stops, less the different ones that are not blank."""
    pieces = F.split(text, r"\.")
    return F.size(pieces) - F.size(F.array_distinct(F.filter(F.transform(pieces, strip), lambda s: s != "")))


def patterns(text: Column) -> Column:
    """Map of kind to the different matches, sorted; kinds without a match are left out."""
    found = []
    for kind, (regexes, _) in PATTERNS.items():
        flag = "(?i)" if kind == "dates" else ""
        lists = [F.regexp_extract_all(text, F.lit(flag + p), F.lit(0)) for p in regexes]
        found += [F.lit(kind), F.sort_array(F.array_distinct(F.concat(*lists)))]
    return F.map_filter(F.create_map(*found), lambda _, v: F.size(v) > 0)


def pattern_confidences(found: Column) -> Column:
    """The confidence of each kind that was found."""
    known = F.create_map(*[x for k, (_, c) in PATTERNS.items() for x in (F.lit(k), F.lit(c))])
    return F.map_filter(known, lambda k, _: F.map_contains_key(found, k))


def language_votes(text: Column) -> Column:
    """The language with most stop words among the words, the first on ties; `unknown` without any."""
    own = words(F.regexp_replace(F.lower(text), _re(r"[^\w\s]"), ""))
    votes = lambda stops: F.size(F.filter(own, lambda w: w.isin(list(stops))))
    counts = [F.struct(votes(stops).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (lang, stops) in enumerate(STOP_WORDS.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["lang"]).otherwise("unknown")
