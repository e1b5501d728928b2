"""Running totals and ranks within groups of any size, in two levels.

A window over a whole group puts the group into one task. Here rows are dealt by a hash of theirs to about sqrt(n)
buckets in each group: one window totals the rows of a bucket, another the buckets of a group, so that neither level
holds more than about sqrt(n) rows of a group, whatever share of all rows the group has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.sources.tables import written


def bucket_bits(rows: int) -> int:
    """Bits for about sqrt(rows) buckets."""
    return max(0, math.ceil(math.log2(max(1, rows)) / 2))


def bucket_of(order_hash: Column, bits: int) -> Column:
    """The bucket of a 64-bit hash: its highest bits, so that buckets follow each other as the hashes do."""
    return F.shiftrightunsigned(order_hash, 64 - bits).cast("long") if bits else F.lit(0).cast("long")


def running_total(df: DataFrame, keys: list[str], order_hash: str, tie: list[str], value: Column, rows: int, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that come before this one.

    Rows are ordered by (unsigned order_hash, tie); rows equal in all of these take either place. Keys must not be null.
    `df` is read twice: give a written table, or one that is cheap and deterministic.
    """
    bits = bucket_bits(rows)
    df = df.withColumns({"__b": bucket_of(F.col(order_hash), bits), "__v": value})
    by = [*keys, "__b"]
    sums = df.groupBy(*by).agg(F.sum("__v").alias("__s"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*by, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = W.partitionBy(*by).orderBy(order_hash, *tie).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("__r", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return df.join(starts, by).withColumn(out, F.col("__r") + F.col("__o")).drop("__b", "__v", "__r", "__o")


def global_totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name of `sums` the sum of its column over the rows that come before this one in `order`.

    Rows lie in ranges of the order; a window totals the rows of a range, another the ranges. Rows that are equal in
    `order` take either place, and lie in the same range.
    """
    ranged = df.repartitionByRange(*order).withColumns({"__p": F.spark_partition_id(), **{f"__v_{n}": c for n, c in sums.items()}})
    ranged = written(ranged, "ranged")
    above = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy("__p").agg(*[F.sum(f"__v_{n}").alias(n) for n in sums])
    starts = parts.select("__p", *[F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"__o_{n}") for n in sums])
    before = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = ranged.withColumns({f"__r_{n}": F.coalesce(F.sum(f"__v_{n}").over(before), F.lit(0)) for n in sums})
    out = inside.join(F.broadcast(starts), "__p").withColumns({n: F.col(f"__r_{n}") + F.col(f"__o_{n}") for n in sums})
    return out.drop("__p", *[f"__{k}_{n}" for k in "vor" for n in sums])


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds `out`: the place from 0 of each row in the order of all rows."""
    return global_totals(df, order, {out: F.lit(1).cast("long")})


def in_ranges(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """`df` as a written table in ranges of (by, order), with their numbers `__p`: a group of any size lies in several.

    Ranges follow each other as the rows do, so that what one hands on to the next is a row for each (by, __p). Rows that
    are equal in all of these columns lie in the same one. `df` is run once more for a sample of its order.
    """
    return written(df.repartitionByRange(by, *order).withColumn("__p", F.spark_partition_id()), "ranges")


def with_parts(rows: DataFrame, parts: DataFrame, by: str) -> DataFrame:
    """Rows of ranges with the columns of their (by, __p) in `parts`; null is a group as others are."""
    named = parts.withColumnsRenamed({by: "__by", "__p": "__q"})
    return rows.join(named, (F.col("__p") == F.col("__q")) & F.col(by).eqNullSafe(F.col("__by"))).drop("__by", "__q")


def parts_before(by: str) -> W:
    """The window of a group's ranges that come before one."""
    return W.partitionBy(by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)


def inside(by: str, order: list[str]) -> W:
    """The window of a group's rows in one range, in order."""
    return W.partitionBy("__p", by).orderBy(*order)
