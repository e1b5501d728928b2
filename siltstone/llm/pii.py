"""Personal data, native: patterns propose spans, checksums confirm them, context words adjust their scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import text_or_empty

#: Stand for a separator that lies between two characters of a run, so that a pattern can take the run by one class.
#: Repeated groups of varying length would use Java's stack for each round, and long runs would overflow it.
DOT, GAP, OTHER = "\x02", "\x01", "\x03"
DOMAIN = "A-Za-z0-9-"
LOCAL = rf"A-Za-z0-9._%+{DOT}-"
CONTEXT_CHARS = 40
#: Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
#: So many parts of a text are walked in one go; more are cut into lots.
FEW = 32
#: Spans of the kinds beyond the base are given from this score on.
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    """`probe` is a cheap necessary condition; `context` are words near a span that raise its score."""

    name: str
    pattern: str
    probe: str
    context: str
    score: float
    base: bool = True


KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++{DOT}[{DOMAIN}{DOT}]*+", "@", r"e-?mail|contact|write to", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", r"\bip\b|address|host|server", 0.6),
    Kind("card", rf"(?<![0-9{GAP}])[0-9](?:{GAP}?[0-9]){{12,18}}+(?![0-9{GAP}])", r"[0-9](?:[ -]?[0-9]){12}", r"card|visa|credit|debit|payment", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"phone|call|tel|mobile|fax", 0.7),
    Kind("iban", rf"(?<![A-Z0-9])(?:{IBAN})(?![A-Z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{3}", r"iban|account|bank|konto|cuenta|compte", 0.8, False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", r"ssn|social security", 0.4, False),
)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn sum."""
    digit = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, double(digit(i))).otherwise(digit(i))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN leaves 1 by 97: four first characters last, letters as 10 to 35."""
    plain = F.translate(iban, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return mod97(match) if kind == "iban" else F.lit(True)


def _marked(kind: str, text: Column) -> Column:
    """The text with the separators inside runs marked; every character stays at its place."""
    if kind == "email":
        return F.regexp_replace(F.translate(text, DOT, OTHER), rf"(?<=[{DOMAIN}])\.(?=[{DOMAIN}])", DOT)
    if kind == "card":
        return F.regexp_replace(F.translate(text, GAP, OTHER), "(?<=[0-9])[ -](?=[0-9])", GAP)
    return text


SPANS = "array<struct<start:bigint,end:bigint,score:double>>"


def parts(kind: Kind, text: Column) -> Column:
    """The text as an array of (piece, match, after): each match with the pieces around it; the last has no match."""
    pieces = F.split(text, kind.pattern, -1)
    return F.arrays_zip(pieces.alias("piece"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("after"))


def lots(zipped: Column) -> Column:
    """An array cut into about as many lots as each has elements."""
    n = F.ceil(F.sqrt(F.size(zipped))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(zipped, i * n + 1, n))


def found(kind: Kind, zipped: Column) -> Column:
    """Confirmed spans of a kind: array of (start, end, score), in code points, from its parts.

    Lengths of the matches and of the pieces between them add up to places. An array that grows is copied for each
    element, and so is kept to the root of the number of matches: of many, places of lots come first, then those inside.
    """
    length = lambda x: (F.length(x["piece"]) + F.coalesce(F.length(x["match"]), F.lit(0))).cast("bigint")
    tail = lambda x: F.substr(x, F.greatest(F.lit(1), F.length(x) - CONTEXT_CHARS + 1))
    near = lambda x: F.lower(F.concat(tail(x["piece"]), F.lit(" "), F.substr(F.coalesce(x["after"], F.lit("")), F.lit(1), F.lit(CONTEXT_CHARS)))).rlike(kind.context)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        score = F.lit(kind.score) + F.when(near(x), 0.3).otherwise(0.0)
        good = x["match"].isNotNull() & confirmed(kind.name, x["match"])
        good = good if kind.base else good & (score >= THRESHOLD)
        one = F.struct(start.alias("start"), end.alias("end"), F.least(F.lit(1.0), score).alias("score"))
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    begun = lambda at: F.struct(at.alias("at"), F.array().cast(SPANS).alias("out"))
    walked = lambda rows, at: F.aggregate(rows, begun(at), step, lambda acc: acc["out"])
    lots_ = lots(zipped)
    sums = F.transform(lots_, lambda lot: F.aggregate(lot, F.lit(0).cast("bigint"), lambda n, x: n + length(x)))
    starts = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    placed = F.arrays_zip(lots_.alias("lot"), F.slice(starts, F.lit(1), F.size(lots_)).alias("at"))
    many = F.flatten(F.transform(placed, lambda p: walked(p["lot"], p["at"])))
    return F.when(F.size(zipped) <= FEW, walked(zipped, F.lit(0).cast("bigint"))).otherwise(many)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with a column for each kind's spans: pii_email, pii_ip, pii_card, pii_phone, pii_iban and pii_ssn.

    Base kinds give every confirmed match, with a score; iban needs its checksum and ssn a context word before or after
    it. Null and empty texts have none. Work grows with the length of a text, and with the power 1.5 of the number of
    matches in it. Every row is judged alone; no rows: none; columns with the names of added ones are replaced.
    """
    text = text_or_empty(text_col)
    docs = docs.withColumns({f"__{k.name}": F.when(text.contains(k.probe) if k.probe == "@" else text.rlike(k.probe), _marked(k.name, text)) for k in KINDS})
    docs = docs.withColumns({f"__{k.name}": F.when(F.col(f"__{k.name}").isNotNull(), parts(k, F.col(f"__{k.name}"))) for k in KINDS})
    none = F.array().cast(SPANS)
    docs = docs.withColumns({f"pii_{k.name}": F.when(F.col(f"__{k.name}").isNotNull(), found(k, F.col(f"__{k.name}"))).otherwise(none) for k in KINDS})
    return docs.drop(*[f"__{k.name}" for k in KINDS])


def spans_text(kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end of all spans, comma-joined."""
    named = lambda k: F.transform(f"pii_{k.name}", lambda s: F.concat_ws(":", F.lit(k.name), s["start"], s["end"]))
    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def op9_query(docs: DataFrame) -> DataFrame:
    out = find_pii(docs.select("doc_id", "text"))
    base = tuple(k for k in KINDS if k.base)
    counts = [F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in base]
    best = F.array_max(F.concat(*[F.transform(f"pii_{k.name}", lambda s: s["score"]) for k in KINDS]))
    return out.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(KINDS).alias("spans"), best.alias("top_score"))
