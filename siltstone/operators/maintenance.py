"""Updates, retention and archives of stored tables, by partitions: what isn't touched is neither read nor written.

A change is computed from the touched partitions into a table of its own, which then replaces them, each as a whole. So
a run that is broken off leaves partitions as they were or as they will be, and running it again gives the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.stored import archived, retained, update
from siltstone.sources.tables import delete, dropped, written


def store(df: DataFrame, path: str, by: str) -> None:
    """A new table in partitions of `by`."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def _parts(df: DataFrame, by: str) -> list:
    """The partitions of some rows; there are as many as a table has folders."""
    return [r[0] for r in df.select(by).distinct().collect()]


def _in(df: DataFrame, by: str, parts: list) -> DataFrame:
    none = F.col(by).isNull() if None in parts else F.lit(False)
    return df.where(F.col(by).isin([p for p in parts if p is not None]) | none)


def _there(spark: SparkSession, path: str, by: str) -> bool:
    """Whether the table has a partition; one that has lost all can't be read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}=*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def replace_partitions(spark: SparkSession, path: str, by: str, rows: DataFrame, touched: list) -> None:
    """The touched partitions have `rows` from now on, and go if they have none; rows of other partitions are an error."""
    new = written(rows, "partitions")
    left = set(_parts(new, by))
    if not left <= set(touched):
        raise ValueError(f"rows of partitions that are not replaced: {sorted(map(str, left - set(touched)))}")
    if left:
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for part in touched:
        if part not in left:
            delete(spark, f"{path}/{by}={'__HIVE_DEFAULT_PARTITION__' if part is None else part}")
    dropped(new)


def update_stored(spark: SparkSession, path: str, by: str, changes: DataFrame, key: str, allowed: Sequence[str], order: str | None = None) -> list:
    """The table after the last change of each key; gives the partitions that it replaced.

    Keys alone are read of the whole table, to find the partitions. `by` itself cannot be changed.
    """
    if by in allowed:
        raise ValueError("a change of the partition would move rows")
    if not _there(spark, path, by):
        return []
    table = spark.read.parquet(path)
    changes = written(changes, "changes")
    touched = _parts(table.select(key, by).join(changes.select(key).distinct(), key, "left_semi"), by)
    replace_partitions(spark, path, by, update(_in(table, by, touched), changes, key, allowed, order), touched)
    return touched


def _before(spark: SparkSession, path: str, by: str, as_of: str, days: int) -> list:
    """Partitions, days of a time, that may hold rows older than `days`."""
    if not _there(spark, path, by):
        return []
    cut = F.to_date(F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    return _parts(spark.read.parquet(path).where(F.col(by) <= cut), by)


def retain_stored(spark: SparkSession, path: str, by: str, time: str, as_of: str, days: int, also: Column | None = None) -> list:
    """Deletes rows older than `days` for which the other condition holds; gives the partitions it looked at.

    `by` is the day of `time`: later days are neither read nor written.
    """
    touched = _before(spark, path, by, as_of, days)
    if touched:
        rows = retained(_in(spark.read.parquet(path), by, touched), time, as_of, days, also)
        replace_partitions(spark, path, by, rows.where("not deleted").drop("deleted"), touched)
    return touched


def archive_stored(spark: SparkSession, live: str, archive: str, by: str, time: str, as_of: str, days: int, key: str) -> list:
    """Moves rows older than `days` to the archive, where they replace those with their key in their partition.

    The archive is written first: a run that is broken off in between leaves rows in both, and the next one mends that.
    """
    touched = _before(spark, live, by, as_of, days)
    if touched:
        now = _in(spark.read.parquet(live), by, touched)
        before = _in(spark.read.schema(now.schema).parquet(archive), by, touched) if _there(spark, archive, by) else now.limit(0)
        stays, moved = archived(now, before, time, as_of, days, key)
        stays, moved = written(stays, "stays"), written(moved, "moved")
        if not moved.isEmpty():
            replace_partitions(spark, archive, by, moved, touched) if _there(spark, archive, by) else store(moved, archive, by)
        replace_partitions(spark, live, by, stays, touched)
    return touched
