"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import dropped, written


def _to_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and its neighbours v.

    The minima are a written table, so that both sides of the join are plain exchanges and AQE can split a hub's rows.
    """
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return edges.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) for each node of an edge; component is the least node that can be reached.

    Nodes are of any ordered type; edges with a null end, loops and repeats have no effect (a node with loops alone is
    absent). Rounds grow with the logarithm of the longest path; each is written to the shared folder, and what goes
    to the driver is one checksum.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = _to_minimum(large)
        up: Column = F.explode(F.array(F.col("u"), F.col("v")))
        after = written(small.select(up.alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "edges")
        if (then := mark(after)) == seen:
            now = after
            break
        dropped(large)
        dropped(now)
        now, seen = after, then
    low = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low)
