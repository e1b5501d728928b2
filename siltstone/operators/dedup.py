"""Duplicates of content: exact, by URL, near; their groups, scores and best versions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.functions import urls
from siltstone.operators.bloom import excluding, including
from siltstone.operators.components import connected_components
from siltstone.operators.pairs import similar_pairs
from siltstone.sources.tables import written

#: Near duplicates are compared on so many words in a row, and linked from this Jaccard similarity on.
SHINGLE, SIMILAR = 5, 0.8
#: All bytes but the letters and digits of lower-cased ASCII.
NO_LETTERS = bytes(b for b in range(256) if b not in b"abcdefghijklmnopqrstuvwxyz0123456789")


def fingerprints(content: DataFrame, id_col: str = "_id") -> DataFrame:
    """One row per content row, without its text. Null texts count as empty."""
    c = content.withColumn("__c", F.coalesce("content", F.lit("")))
    parts = tx.structure(F.col("__c"))
    c = c.withColumns({"paragraphs": parts["paragraphs"], "sentences": parts["sentences"], "words": parts["words"]})
    return c.select(
        F.col(id_col).alias("id"), tx.text_fingerprint(F.col("__c")).alias("text_fp"), tx.text_fingerprint(F.coalesce("title", F.lit(""))).alias("title_fp"), urls.fingerprint(F.col("url")).alias("url_fp"),
        F.length("__c").cast("long").alias("length"), F.col("words").cast("long").alias("words"), tx.structure_fingerprint(F.col("paragraphs"), F.col("sentences"), F.col("words")).alias("structure_fp"),
    )


def text_prints(content: DataFrame, id_col: str = "_id") -> DataFrame:
    """(id, text_fp) as `fingerprints` has them where another row may have the same; elsewhere text_fp is a name of the row's own.

    A fingerprint keeps all letters and digits of its lower-cased text in order, so texts of equal ones agree in those of
    ASCII. Only rows that share these with others are searched by patterns, which takes most of the time.
    """
    kind = content.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [t.encode().translate(None, NO_LETTERS) for t in b.column(1).to_pylist()]
            hashes = [int.from_bytes(hashlib.md5(k).digest()[:8], "little", signed=True) for k in kept]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.int64())], ["id", "letters"])

    rows = content.select(id_col, F.lower(F.coalesce("content", F.lit(""))))
    seen = written(rows.mapInArrow(run, f"id {kind}, letters bigint"), "seen")
    alike = written(seen.groupBy("letters").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("letters"), "alike")
    asked = written(seen.join(alike, "letters").select("id"), "asked")
    some = including(content, {"id": F.col(id_col)}, asked).select(F.col(id_col).alias("id"), tx.text_fingerprint(F.coalesce("content", F.lit(""))).alias("text_fp"))
    others = excluding(seen.select("id"), {"id": F.col("id")}, asked)
    return some.unionByName(others.select("id", F.concat(F.lit("#"), F.col("id").cast("string")).alias("text_fp")))


def groups(prints: DataFrame, *keys: str) -> DataFrame:
    """Keys of several rows: how many, the least id of them."""
    return prints.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


def pattern_only(prints: DataFrame) -> DataFrame:
    """Rows with a copy or an equal URL: the ids they duplicate, each once; score 1, each its own best."""
    exact = written(groups(prints, "text_fp", "title_fp").select("text_fp", "title_fp", F.col("first_id").alias("exact_id")), "exact")
    same = written(groups(prints, "url_fp").select("url_fp", F.col("first_id").alias("url_id")), "urls")
    out = prints.join(exact, ["text_fp", "title_fp"], "left").join(same, "url_fp", "left")
    ids = F.array_sort(F.array_distinct(F.array_compact(F.array("exact_id", "url_id"))))
    return out.select("id", ids.alias("duplicates"), F.col("id").alias("best_id"), F.when(F.size(ids) > 0, 1.0).otherwise(0.0).alias("confidence")).where(F.size("duplicates") > 0)


def attach(content: DataFrame, analysis: DataFrame, id_col: str = "_id") -> DataFrame:
    """Content with its duplicate analysis, null where there is none."""
    named = analysis.select(F.col("id").alias("__a"), *[F.col(c) for c in analysis.columns if c != "id" and c not in content.columns])
    return content.join(named, content[id_col] == named["__a"], "left").drop("__a")


def hash_only(content: DataFrame, id_col: str = "_id") -> DataFrame:
    """By md5 of the raw text; the least id is kept."""
    rows = content.select(F.col(id_col).alias("id"), F.md5(F.coalesce("content", F.lit(""))).alias("hash"))
    first = written(rows.groupBy("hash").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("copies")), "hashes")
    out = rows.join(first, "hash")
    return out.select("id", "kept_id", "copies", (F.col("id") != F.col("kept_id")).alias("duplicate"), F.when(F.col("copies") > 1, F.lit(0.95)).otherwise(F.lit(1.0)).alias("confidence"))


def representatives(prints: DataFrame) -> DataFrame:
    """One row for each text: the one of the least id."""
    return prints.groupBy("text_fp").agg(F.min_by(F.struct("id", "structure_fp", "length", "words"), "id").alias("r")).select("text_fp", "r.*")


def near_candidates(prints: DataFrame) -> DataFrame:
    """Pairs of the same structure whose lengths are within 20 and words within 25 percent of the larger.

    One row for each text: rows of equal text are copies, and an exact link stands for them. So a group of copies makes
    no pairs, and a structure as many as it has different texts of like length.
    """
    texts = representatives(prints)
    a = texts.select(*[F.col(c).alias(f"{c}_a") for c in texts.columns])
    b = texts.select(*[F.col(c).alias(f"{c}_b") for c in texts.columns])
    close = lambda c, share: F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= F.lit(share) * F.greatest(f"{c}_a", f"{c}_b")
    on = (F.col("structure_fp_a") == F.col("structure_fp_b")) & (F.col("id_a") < F.col("id_b")) & close("length", 0.2) & close("words", 0.25)
    return a.join(b, on).select("id_a", "id_b", F.greatest("length_a", "length_b").alias("longer"), F.abs(F.col("length_a") - F.col("length_b")).alias("difference"))


def singled(content: DataFrame, prints: DataFrame, id_col: str = "_id") -> DataFrame:
    """The rows of `content` that stand for their texts, those of the least id.

    What is shuffled are the copies, not the texts.
    """
    least = written(prints.groupBy("text_fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copied")
    copies = written(prints.join(least, "text_fp").where("id <> first_id").select("id"), "copies")
    return excluding(content, {"id": F.col(id_col)}, copies)


def near_pairs(content: DataFrame, prints: DataFrame, similar: float = SIMILAR, id_col: str = "_id") -> DataFrame:
    """All pairs of different texts whose shingles have a Jaccard similarity of `similar` at least.

    The least id of a text stands for its copies, as in J6; the structure of texts is not looked at. Sets of shingles
    are made anew from the texts that have candidates, and not stored.
    """
    out = similar_pairs(singled(content.select(id_col, "content"), prints, id_col), similar, id_col, SHINGLE)
    longer, difference = F.greatest("length_a", "length_b"), F.abs(F.col("length_a") - F.col("length_b"))
    return out.select("id_a", "id_b", "jaccard", (F.lit(1.0) - difference / F.greatest(F.lit(1), longer)).alias("length_score"))


def duplicate_edges(content: DataFrame, near: bool = True, similar: float = SIMILAR, id_col: str = "_id") -> DataFrame:
    """(a, b, kind, score): exact 1.0, url 0.9 and near by length, the last kind of a pair counts.

    Copies are linked to the least id of their group, so that a group has as many links as rows.
    """
    prints = written(fingerprints(content, id_col).select("id", "text_fp", "title_fp", "url_fp"), "prints")

    def stars(keys: list[str], kind: str, score: float) -> DataFrame:
        least = written(groups(prints, *keys), kind)
        return prints.join(least, keys).where(F.col("id") != F.col("first_id")).select(F.col("first_id").alias("a"), F.col("id").alias("b"), F.lit(kind).alias("kind"), F.lit(score).alias("score"))

    edges = stars(["text_fp", "title_fp"], "exact", 1.0).unionByName(stars(["url_fp"], "url", 0.9))
    if near:
        pairs = near_pairs(content, prints, similar, id_col)
        edges = edges.unionByName(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit("near").alias("kind"), F.col("length_score").alias("score")))
    order = F.when(F.col("kind") == "near", 3).when(F.col("kind") == "url", 2).otherwise(1)
    best = edges.groupBy("a", "b").agg(F.max_by(F.struct("kind", "score"), order).alias("s"))
    return best.select("a", "b", "s.kind", "s.score")


def duplicate_analysis(content: DataFrame, near: bool = True, similar: float = SIMILAR, id_col: str = "_id", quality: str = "content_quality_score") -> DataFrame:
    """One row per content row: its component, the component's size, best version, the row's confidence, advice.

    Best is the highest quality, the least id on ties; a row without duplicates is its own best, with confidence 0.
    """
    edges = written(duplicate_edges(content, near, similar, id_col), "edges")
    parts = written(connected_components(edges), "parts")
    rows = content.select(F.col(id_col).alias("id"), F.col(quality).alias("q"))
    linked = written(rows.join(parts, rows["id"] == parts["node"]).select("id", "q", "component"), "linked")
    best = written(linked.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.coalesce("q", F.lit(-1.0))).alias("q"), "id"))["id"].alias("best_id")), "best")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "score").groupBy("id").agg(F.max("score").alias("confidence"))
    found = linked.join(best, "component").join(ends, "id").select("id", "component", "group_size", "best_id", "confidence")
    alone = rows.join(parts, rows["id"] == parts["node"], "left_anti").select("id", F.col("id").alias("component"), F.lit(1).cast("long").alias("group_size"), F.col("id").alias("best_id"), F.lit(0.0).alias("confidence"))
    keep = F.when(F.col("group_size") > 1, F.concat(F.lit("Keep "), F.col("best_id").cast("string"), F.lit(", remove others")))
    return found.unionByName(alone).withColumn("advice", keep)


def best_versions(content: DataFrame, id_col: str = "_id") -> DataFrame:
    """Content rows that are the best version of their group."""
    best = duplicate_analysis(content, id_col=id_col).where("id = best_id").select(F.col("id").alias(id_col))
    return content.join(best, id_col, "left_semi")


def similar_content(content: DataFrame, asked: DataFrame, least: float, limit: int = 10, similar: float = SIMILAR, id_col: str = "_id") -> DataFrame:
    """J5 for many rows: for each id of `asked` the rows that score `least` at least, best first, with their place.

    A copy scores 1.0, an equal URL 0.9, a near duplicate by length; the highest counts. Rows of one text have the same
    score, so the first limit + 1 of them are enough: the row itself may be one.
    """
    prints = written(fingerprints(content, id_col).select("id", "text_fp", "url_fp"), "prints")
    near = written(near_pairs(content, prints, similar, id_col), "near")
    ask = asked.select("id")

    def by(keys: list[str], other: DataFrame | None, score: float) -> DataFrame:
        first = written(prints.groupBy(*keys).agg(F.min("id").alias("first_id")), "first")
        rows = written(prints.join(first, keys).select("id", "first_id"), "rows")
        few = rows.withColumn("__p", F.row_number().over(W.partitionBy("first_id").orderBy("id"))).where(F.col("__p") <= limit + 1).select(F.col("id").alias("member"), F.col("first_id").alias("to"))
        mine = rows.join(ask, "id", "left_semi")
        links = mine.select("id", F.col("first_id").alias("to"), F.lit(score).alias("score"))
        if other is not None:
            links = links.unionByName(mine.join(other, "first_id").select("id", "to", "score"))
        return links.join(few, "to").select("id", "member", "score")

    ways = [near.select(F.col(f"id_{a}").alias("first_id"), F.col(f"id_{b}").alias("to"), F.col("length_score").alias("score")) for a, b in ("ab", "ba")]
    found = by(["text_fp"], ways[0].unionByName(ways[1]), 1.0).unionByName(by(["url_fp"], None, 0.9))
    best = found.where((F.col("id") != F.col("member")) & (F.col("score") >= least)).groupBy("id", "member").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "member"))
    return best.withColumn("place", place).where(F.col("place") <= limit)
