"""The stream queries over events in one file and in a folder of part files, and where their rows go."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siltstone.plans import catalogue

QUERIES = catalogue.queries()


@pytest.mark.parametrize("name", ["stream_hourly", "stream_endpoints", "stream_rate_limit"])
def test_part_files_give_what_one_file_gives(name, spark, sf_dir, tmp_path):
    parts = spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(4, "ts").sortWithinPartitions("ts")
    parts.write.parquet(f"{tmp_path}/events.parquet")
    got, want = (sorted(map(str, QUERIES[name](spark, d).collect())) for d in (str(tmp_path), sf_dir))
    assert got == want and got


def test_rate_limit_stream_keeps_no_rows_in_the_driver(spark, sf_dir, monkeypatch):
    keep = DataStreamWriter.format
    monkeypatch.setattr(DataStreamWriter, "format", lambda self, name: pytest.fail("memory sink") if name == "memory" else keep(self, name))
    got = QUERIES["stream_rate_limit"](spark, sf_dir).agg(F.sum("requests")).first()[0]
    assert got == spark.read.parquet(f"{sf_dir}/events.parquet").count()
