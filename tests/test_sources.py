from __future__ import annotations

import json

from pyspark.sql import functions as F

from siltstone.functions import model_output as mo
from siltstone.functions import text as tx
from siltstone.sources import schemas, sinks


def test_rows_conform_and_are_appended(spark, tmp_path):
    df = spark.createDataFrame([("1", "http://a", "12", "x", "2024-01-01 10:00:00"), ("2", None, "no", "y", None)], "_id string, url string, content_size_bytes string, other string, timestamp string")
    path = str(tmp_path / "content")
    sinks.append(df, "content", path, "timestamp")
    sinks.append(df, "content", path, "timestamp")
    rows = spark.read.schema(schemas.schema("content")).parquet(path).orderBy("_id").collect()
    assert [(r["_id"], r["content_size_bytes"], r["author"]) for r in rows] == [("1", 12, None)] * 2 + [("2", None, None)] * 2
    for name in schemas.SCHEMAS:
        assert schemas.conform(df, name).schema.fieldNames() == schemas.schema(name).fieldNames()


def test_load_tests_and_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"scenario": "s", "started": "2024-01-01T00:00:00", "requests": [{"duration_ms": 1.5, "status": 200}, {"duration_ms": 2.5, "status": 500}]}, indent=1))
    rows = sinks.load_tests(spark, str(tmp_path / "a.json"))
    assert [(r["request"], r["duration_ms"]) for r in rows.orderBy("request").collect()] == [(0, 1.5), (1, 2.5)]
    sinks.export_json(rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).collect()[0]["n"] == 2


def test_keys_and_error_classes(spark):
    row = spark.range(1).select(tx.cache_key(b=F.lit(1), a=F.lit("x")).alias("k"), tx.cache_key(a=F.lit("x"), b=F.lit(1)).alias("l"), mo.error_class(F.lit("Bad API key")).alias("e"), mo.error_class(F.lit("Quota exceeded")).alias("q")).first()
    assert row["k"] == row["l"] and (row["e"], row["q"]) == ("auth", "quota")
