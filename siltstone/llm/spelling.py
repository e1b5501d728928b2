"""Spelling variants: words at edit distance 1, found by an index of variable-length grams.

The dictionary has the frequent grams: those of MIN_GRAM to MAX_GRAM code points that more than so many words hold, so
that their number is bounded. At each place of a word, closed by marks at both ends, its gram is the shortest one that is
not frequent, or MAX_GRAM long: rare beginnings give short grams, common ones grow. A gram depends on no code point
beyond its own, so an edit changes those alone that span it, at most `affected` of a word; no edit can reach them all.

Lists of grams are merged by that bound: of a word's grams in the order of their frequency the first affected + 1 are
entries, since the most frequent ones, which an edit may leave as the only common grams, then need not be looked at. The
least gram that two near words share is in both beginnings. It stands at the same place from the start, or from the end
if it comes after the edit, so that lists are cut by places too. What shares an entry is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import slices, text_or_empty
from siltstone.sources.tables import dropped, written

MIN_GRAM, MAX_GRAM = 2, 5
#: A gram is frequent if so many words or more hold it, and one in so many of all places of words.
LEAST_FREQUENT, MOST_FREQUENT = 500, 20_000
#: Words are of so many code points and come so often, at least; no edit reaches all grams of words of MAX_GRAM or more.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Different words that a task counts before it hands them on.
COUNTED = 500_000
#: Spark's levenshtein takes time with the square of the length, whatever its bound; longer words are compared otherwise.
SHORT = 64
BEGIN, END = "\x02", "\x03"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = 0) -> DataFrame:
    """(word, n): the words of all texts, of `least_length` code points and `least_count` occurrences at least.

    A word is a longest run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. With `slips`, a word loses the code
    point h % length where `slips` divides h, the crc32 of '<id>:<word>'; rows without an id have no slips. Null and
    empty texts have no words; repeated rows count as often. No rows: none.
    """
    runs = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % max(1, least_length)).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        counts: Counter[bytes] = Counter()
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # the characters of words are those of Latin-1, a byte each; the rest is replaced by a sign that is in no word
                found = Counter(runs(text.encode("latin-1", "replace").lower()))
                if not slips or doc is None:
                    counts.update(found)
                    continue
                begun = zlib.crc32(doc.encode() + b":")
                for w, n in found.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
                    if h % slips == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                    counts[w] += n
            if len(counts) > COUNTED:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    rows = docs.select(F.col(id_col).cast("string").alias("d"), text_or_empty(text_col).alias("t")).mapInArrow(count, "word string, n bigint")
    return rows.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, least: int = LEAST_FREQUENT, most: int = MOST_FREQUENT) -> dict[str, int]:
    """The frequent grams with their numbers; of each length `most` at the very most, so the driver may hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[str] = Counter()
            for w in b.column(0).to_pylist():
                s = BEGIN + w + END
                counts.update(s[i : i + q] for q in range(MIN_GRAM, MAX_GRAM + 1) for i in range(len(s) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "c"])

    places = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    sums = words.select("word").mapInArrow(count, "gram string, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))
    return {r["gram"]: r["c"] for r in sums.where(F.col("c") > max(least, places // most)).collect()}


def grams(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """The variable gram at each place of a word between its marks."""
    s, out = BEGIN + word + END, []
    for at in range(len(s) - 1):
        q = MIN_GRAM
        while q < MAX_GRAM and at + q < len(s) and s[at : at + q] in frequent:
            q += 1
        out.append((at, s[at : at + q]))
    return out


def affected(found: list[tuple[int, str]]) -> int:
    """The most grams that one edit can change: those that span a code point. Marks are not edited."""
    spans = [0] * (len(found) + 2)
    for at, g in found:
        spans[at] += 1
        if at + len(g) < len(spans):
            spans[at + len(g)] -= 1
    most = now = 0
    for i in range(len(found)):  # the last place is the end mark
        now += spans[i]
        if i:
            most = max(most, now)
    return most


def entries(word: str, frequent: dict[str, int]) -> list[tuple[int, int, str]]:
    """(place from the start, from the end, gram) of the affected + 1 rarest grams."""
    found = grams(word, frequent)
    first = sorted(found, key=lambda g: (frequent.get(g[1], 0), g[1], g[0]))[: affected(found) + 1]
    return [(at, len(found) + 1 - at - len(g), g) for at, g in first]


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two different words are near, of which b is the longer one if their lengths differ."""
    differ = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), False)
    same = F.substr(a, differ + F.when(F.length(a) == F.length(b), 1).otherwise(0)) == F.substr(b, differ + 1)
    return F.when(F.length(a) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise(same)


def near_words(words: DataFrame, least: int = LEAST_FREQUENT, most: int = MOST_FREQUENT) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of `words` (word, n), each once, that differ by one inserted, deleted or replaced code point.

    Words are different, and of MAX_GRAM code points at least; shorter ones are in no pair. A pair of different lengths
    has its shorter word first. No rows: none.
    """
    words = words.where(F.length("word") >= MAX_GRAM)
    frequent = frequent_grams(words, least, most)

    def listed(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                keys, rows = [], []
                for k, w in enumerate(b.column(0).to_pylist()):
                    for s, e, g in entries(w, frequent):
                        g = g.encode()
                        # the other word is as long, or longer: by a code point after the gram, or before it
                        for x, y in ((s, e), (s, e + 1), (s + 1, e)) if asked else ((s, e),):
                            keys.append(xxhash.xxh64_intdigest(g, (x << 32) + y) - (1 << 63))
                            rows.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[b.column(i).take(pa.array(rows, pa.int64())) for i in (0, 1)]], names)

        names = ["key", "a", "n_a"] if asked else ["key", "b", "n_b"]
        return words.select("word", F.col("n").cast("long")).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, ("bigint", "string", "bigint"), strict=True)))

    both = listed(True).join(listed(False), "key")
    once = (F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))
    return both.where(once & _one_edit(F.col("a"), F.col("b"))).groupBy("a", "b").agg(F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by pointer jumping over written tables."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(now)
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def variant_groups(words: DataFrame, factor: int = 2, least: int = LEAST_FREQUENT, most: int = MOST_FREQUENT) -> DataFrame:
    """One row per word of `words` (word, n): word, form, root, n, n_near, form_n.

    A word's form is its near word of the largest n, of equal ones the first by code points, if that n is `factor` times
    its own or more; the root is the last of forms followed from it. Words are different. No rows: none.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = written(near_words(words, least, most), "near")
    each = pairs.select(F.col("a").alias("word"), F.col("b").alias("o"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("o"), F.col("n_a").alias("m")))
    best = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "o")).alias("f"))
    enough = -F.col("f.m") >= factor * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("f.o")).alias("form"), F.when(enough, -F.col("f.m")).alias("form_n"))
    out = written(out, "forms")
    roots = _roots(out.where(F.col("form").isNotNull()))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_query(docs: DataFrame) -> DataFrame:
    return variant_groups(word_counts(docs.select("doc_id", "text"), slips=97))
