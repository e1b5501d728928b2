"""Queries take all rows of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import aggregates
from siltstone.plans import catalogue
from siltstone.sources import adapters as ad

QUERIES = catalogue.queries()


def test_comparison_takes_all_rows(spark, sf_dir):
    got = QUERIES["stage_compare"](spark, sf_dir).agg(F.sum("baseline") + F.sum("current")).first()[0]
    want = ad.requests_t(spark, sf_dir).agg(F.sum("duration_ms")).first()[0]
    assert abs(got - want) < 1e-3 * want / 1000
    current = ad.requests_t(spark, sf_dir).where("ts >= '2024-01-15'").groupBy("scenario").agg(F.avg("duration_ms").alias("m"))
    means = {r["scenario"]: round(r["m"], 3) for r in current.collect()}
    assert {r["scenario"]: round(r["current"], 3) for r in QUERIES["baseline_compare"](spark, sf_dir).collect()} == means


def test_every_query_has_its_results(spark, sf_dir):
    got = QUERIES["query_results"](spark, sf_dir)
    queries = ad.queries_t(spark, sf_dir)
    assert got.count() == queries.count() > 200
    assert got.where("_id >= 200 and session_queries is null").count() == 0 == got.join(queries, "_id", "left_anti").count()
    assert got.agg(F.sum("content_count")).first()[0] == ad.content_t(spark, sf_dir).join(queries, F.col("query_id") == queries["_id"]).count()


def test_groups_keep_their_members(spark):
    rows = [(i, f"http://a.com/{i}", None, 1 if i in (2, 3, 5) else 4 if i == 6 else None) for i in range(1, 8)]
    c = spark.createDataFrame(rows, "_id long, url string, title string, duplicate_of long").withColumn("timestamp", F.timestamp_seconds("_id"))
    got = aggregates.duplicate_members(c).select("duplicate_of", "member", "url", "duplicate_count", F.unix_timestamp("timestamp")).collect()
    assert sorted(map(tuple, got)) == [(1, i, f"http://a.com/{i}", 3, i) for i in (2, 3, 5)] + [(4, 6, "http://a.com/6", 1, 6)]
    assert {r["duplicate_of"] for r in aggregates.duplicate_members(c, 1).collect()} == {1}
