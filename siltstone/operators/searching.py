"""Full-text search over a table of postings: words of any text by their stems, phrases by positions, excluded words.

Postings are built once and stored in buckets of their words, so that a search reads the buckets of its own words and no
text. A phrase is found where its words' postings, each taken back by its place in the phrase, fall on one start.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that postings are dealt to by a hash of their stem; as many as the table may have files of a good size.
BUCKETS = 64
_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits, in order; null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORD), "")


def stem(word: Column) -> Column:
    """A word without the ending of a plural or of a verb: ies to y, s after no s, u or i, then ing and ed after three letters.

    Words that end otherwise are not searched.
    """
    singular = F.regexp_replace(F.regexp_replace(word, "^(.{2,})ies$", "$1y"), "^(.{2,}[^sui])s$", "$1")
    ends = reduce(lambda a, b: a | b, [F.endswith(word, F.lit(e)) for e in ("s", "ing", "ed")])
    return F.when(ends, F.regexp_replace(singular, "^(.{3,})(ing|ed)$", "$1")).otherwise(word)


def postings(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(stem, word, id, position): a row for each word of the columns, which follow each other with a place left between them.

    Null and empty texts have none; repeated ids have their postings together.
    """
    parts = [words(F.col(c)) for c in columns]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.array(F.lit("")), p)
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(joined).alias("position", "word")).where("word <> ''")
    return rows.select(stem(F.col("word")).alias("stem"), "word", "id", "position")


def _bucket(stem_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stem_), F.lit(buckets)).cast("int")


def save_postings(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Stores postings by buckets of their stems, sorted, so that footers tell which row groups hold a stem.

    What is dealt out is (stem, position mod 64), so that a word that half of all texts hold is spread over tasks.
    """
    out = df.withColumn("bucket", _bucket(F.col("stem"), buckets))
    out.repartition("bucket", F.col("position") % 64).sortWithinPartitions("bucket", "stem", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class Asked:
    """What a search asks for: any of the words, all of the phrases, none of the excluded words and phrases."""

    any_of: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    none_of: tuple[tuple[str, ...], ...]


def asked(text: str) -> Asked:
    """Reads 'word "a phrase" -excluded -"no phrase"'; a hyphen inside a word parts two words."""
    split = lambda s: tuple(w for w in re.split(r"[\W_]+", s.lower()) if w)
    any_of: list[str] = []
    phrases, none_of = [], []
    for minus, quoted, plain in re.findall(r'(?:(?<=\s)|^)(-?)(?:"([^"]*)"|(\S+))', text):
        found = split(quoted or plain)
        if minus and found:
            none_of += [found] if quoted else [(w,) for w in found]
        elif quoted and found:
            phrases.append(found)
        else:
            any_of += found
    return Asked(tuple(dict.fromkeys(any_of)), tuple(dict.fromkeys(phrases)), tuple(dict.fromkeys(none_of)))


def _of_words(spark: SparkSession, path: str, wanted: Sequence[str], buckets: int) -> DataFrame:
    """The postings of some words' stems; the words are those of one search, so their stems may be literals."""
    stems = spark.createDataFrame([(w,) for w in wanted], "w string").select(stem(F.col("w")).alias("s"), _bucket(stem(F.col("w")), buckets).alias("b")).distinct().collect()
    rows = spark.read.parquet(path)
    return rows.where(F.col("bucket").isin([r["b"] for r in stems]) & F.col("stem").isin([r["s"] for r in stems]))


def _with_phrase(found: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """Ids that hold the words of a phrase in a row: postings taken back to the start of the phrase, as many as it has words."""
    places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(phrase)])
    starts = found.where(F.col("word").isin(list(phrase))).select("id", "word", "position", F.explode(places).alias("p")).where("word = p.w")
    return starts.groupBy("id", (F.col("position") - F.col("p.i")).alias("start")).agg(F.count_distinct("p.i").alias("n")).where(F.col("n") == len(phrase)).select("id").distinct()


def search_postings(spark: SparkSession, path: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, matched): ids that a search finds, with how many of its words and phrases each holds.

    With phrases, an id holds all of them, word by word as written, and other words count only in `matched`; without, it
    holds one word at least by its stem. Excluded words go by their stems, excluded phrases as written. A search without
    a word or phrase finds nothing, whatever it excludes.
    """
    a = asked(text)
    wanted = [*a.any_of, *(w for p in (*a.phrases, *a.none_of) for w in p)]
    none = spark.createDataFrame([], "id long, matched long")
    if not a.any_of and not a.phrases:
        return none
    rows = _of_words(spark, path, wanted, buckets)
    stems = lambda ws: [F.element_at(F.transform(F.array(F.lit(w)), stem), 1) for w in ws]
    hits = None
    if a.any_of:
        hits = rows.where(F.col("stem").isin(*stems(a.any_of))).groupBy("id").agg(F.count_distinct("stem").alias("matched"))
    if a.phrases:
        each = None
        for p in a.phrases:
            one = _with_phrase(rows, p)
            each = one if each is None else each.unionByName(one)
        each = each.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(a.phrases)).withColumnRenamed("n", "matched")
        hits = each if hits is None else each.join(hits.withColumnRenamed("matched", "words"), "id", "left").select("id", (F.col("matched") + F.coalesce("words", F.lit(0))).alias("matched"))
    for p in a.none_of:
        out = rows.where(F.col("stem") == stems(p)[0]).select("id").distinct() if len(p) == 1 else _with_phrase(rows, p)
        hits = hits.join(out, "id", "left_anti")
    return hits
