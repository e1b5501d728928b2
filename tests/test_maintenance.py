from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from siltstone.operators import maintenance as m
from siltstone.sources.tables import fresh


def files(path: str) -> dict[str, float]:
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(path.removeprefix("file://") + "/*/*.parquet")}


def rows_of(spark, path: str) -> list[tuple]:
    return sorted(tuple(r) for r in spark.read.parquet(path).select("id", "status", F.date_format("t", "dd HH").alias("t")).collect())


@pytest.fixture
def stored(spark):
    """Four days of four rows, at 0, 6, 12 and 18 hours."""
    path = fresh(spark, "stored")
    df = spark.range(16).select("id", F.lit("new").alias("status"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 21_600).alias("t"))
    m.store(df.withColumn("day", F.to_date("t")), path, "day")
    return path


def test_update_writes_the_partitions_of_its_keys_alone(spark, stored):
    before = files(stored)
    changes = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (6, None, 1), (99, "z", 1)], "id long, status string, n int")
    for _ in range(2):
        assert [str(d) for d in m.update_stored(spark, stored, "day", changes, "id", ["status"], "n")] == ["2024-01-02"]
        assert {r[0]: r[1] for r in rows_of(spark, stored)} == {i: "b" if i == 5 else "new" for i in range(16)}
    same = {f for f, t in files(stored).items() if before.get(f) == t}
    assert same == {f for f in before if "2024-01-02" not in f} and len(same) >= 3
    assert m.update_stored(spark, stored, "day", changes.limit(0), "id", ["status"]) == []
    with pytest.raises(ValueError):
        m.update_stored(spark, stored, "day", changes, "id", ["day"])


def test_retention_deletes_rows_and_empty_partitions(spark, stored):
    before = files(stored)
    for _ in range(2):
        m.retain_stored(spark, stored, "day", "t", "2024-01-12 12:00:00", 10, F.col("id") != 1)
        assert [r[0] for r in rows_of(spark, stored)] == [1, *range(6, 16)]
    assert {f for f in before if "-03" in f.split("day=")[1] or "-04" in f.split("day=")[1]} <= set(files(stored))
    m.retain_stored(spark, stored, "day", "t", "2024-01-12 12:00:00", 10)
    assert [r[0] for r in rows_of(spark, stored)] == list(range(6, 16)) and not glob.glob(stored.removeprefix("file://") + "/day=2024-01-01")
    m.retain_stored(spark, stored, "day", "t", "2030-01-01", 1)
    assert not files(stored)
    assert m.retain_stored(spark, stored, "day", "t", "2030-01-01", 1) == []  # nothing is left to read
    assert m.update_stored(spark, stored, "day", spark.createDataFrame([(1, "x")], "id long, status string"), "id", ["status"]) == []


def test_a_moved_row_replaces_an_archived_one(spark, stored):
    archive = fresh(spark, "archive")
    old = spark.createDataFrame([(0, "archived"), (77, "archived")], "id long, status string").withColumn("t", F.lit("2024-01-01 05:00:00").cast("timestamp"))
    m.store(old.withColumn("day", F.to_date("t")), archive, "day")
    for _ in range(2):
        m.archive_stored(spark, stored, archive, "day", "t", "2024-01-12 12:00:00", 10, "id")
        assert [r[0] for r in rows_of(spark, stored)] == list(range(6, 16))
        assert [r[:2] for r in rows_of(spark, archive)] == [*((i, "new") for i in range(6)), (77, "archived")]
    # a run that ended between its two writes leaves moved rows in both tables
    again = spark.read.parquet(archive).where("id = 3")
    m.replace_partitions(spark, stored, "day", again, [again.first()["day"]])
    m.archive_stored(spark, stored, archive, "day", "t", "2024-01-12 12:00:00", 10, "id")
    assert [r[0] for r in rows_of(spark, stored)] == list(range(6, 16)) and len(rows_of(spark, archive)) == 7


def test_rows_of_other_partitions_are_an_error(spark, stored):
    with pytest.raises(ValueError):
        m.replace_partitions(spark, stored, "day", spark.read.parquet(stored), [])
