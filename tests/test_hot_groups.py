"""Operators over the requests of a client or path, one of which has most of them: against plain windows, and spread over tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators import logs, prefix


@pytest.fixture(scope="module", autouse=True)
def small_ranges(spark):
    """Small tables would be coalesced into one range."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="module")
def requests(spark):
    draw = random.Random(1)
    rows = [(k, draw.choice(["hot"] * 6 + ["a", "b", "c", None]), 1_700_000_000 + draw.randrange(4000), draw.choice([None, *range(50)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, client string, s long, value long")
    return df.select("event_id", "client", F.timestamp_seconds("s").alias("ts"), F.col("value").cast("double").alias("value")).cache()


def same(a, b) -> bool:
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ranges_split_a_hot_group(spark, requests):
    spread = prefix.in_ranges(requests, "client", ["ts", "event_id"]).where("client = 'hot'").groupBy("__p").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 0.75 * sum(r["count"] for r in spread)


def test_window_counts(requests):
    o = W.partitionBy("client").orderBy("s", "event_id")
    brute = requests.withColumn("s", F.unix_micros("ts")).withColumn("list", F.collect_list(F.struct("s", "event_id")).over(o.rowsBetween(W.unboundedPreceding, 0)))
    brute = brute.select("event_id", F.size(F.filter("list", lambda x: x["s"] > F.col("s") - 60_000_000)).cast("long").alias("in_window"))
    assert same(logs.window_counts(requests, 60).select("event_id", "in_window"), brute)
    twice = requests.unionByName(requests)
    assert logs.window_counts(twice, 60).count() == 6000 and logs.window_counts(twice, 10**6).agg(F.max("in_window")).first()[0] == 2 * requests.where("client = 'hot'").count()
    assert logs.window_counts(requests.limit(0)).count() == 0


@pytest.mark.parametrize("duration", [None, "value"])
def test_polite_schedule(requests, duration):
    got = {r["event_id"]: r["start"] for r in logs.polite_schedule(requests, "client", 7.0, duration).collect()}
    free: dict = {}
    for r in sorted(requests.collect(), key=lambda r: (r["ts"], r["event_id"])):
        start = max(r["ts"].timestamp(), free.get(r["client"], 0.0))
        free[r["client"]] = start + (max(7.0, r["value"] or 0.0) if duration else 7.0)
        assert abs(got[r["event_id"]] - start) < 1e-3
    assert len(got) == 3000 and logs.polite_schedule(requests.limit(0), "client", 7.0).count() == 0


def test_leaks(requests):
    o = W.partitionBy("client").orderBy("ts", "event_id")
    before = requests.withColumn("before", F.lag("value").over(o))
    want = before.withColumn("leak", F.coalesce(F.col("value") > 1.1 * F.col("before"), F.lit(False)))
    assert same(logs.leaks(requests, "client", "ts", "event_id", "value"), want)
    warned = logs.leak_warnings(requests.withColumn("files", F.col("value") * 2), "client", "ts", "event_id", {"value": 1.1, "files": 1.5})
    assert same(warned.select("event_id", F.size("warnings").alias("n")), before.select("event_id", (F.coalesce(F.col("value") > 1.1 * F.col("before"), F.lit(False)).cast("int") + F.coalesce(F.col("value") > 1.5 * F.col("before"), F.lit(False)).cast("int")).alias("n")))


def test_ranked_values(requests):
    want = requests.where("value is not null").groupBy("client", "value").count()
    own = W.partitionBy("client")
    want = want.select("client", F.col("value").alias("v"), F.col("count").alias("c"), F.coalesce(F.sum("count").over(own.orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(own).alias("n"))
    assert same(logs.ranked_values(requests, "client", "value"), want)


def test_overall_status(spark):
    rows = [("crit", "a", 13.0), ("crit", "b", 11.0), ("slow", "a", 11.0), ("slow", "b", 60.0), ("fine", "a", 1.0), ("near", "a", 9.0), ("near", "b", 8.0), ("long", "c", 250.0), ("none", "z", 5.0)]
    df = spark.createDataFrame(rows, "r string, s string, v double")
    limits = {"a": 10.0, "b": 100.0, "z": 0.0}
    got = {x["r"]: (x["slow"], x["critical"], x["total_status"], x["overall"]) for x in logs.overall_status(df, "r", "s", "v", limits, 1000.0, 20.0).collect()}
    assert got == {"crit": (0, 1, "CRITICAL", "FAIL"), "slow": (1, 0, "CRITICAL", "WARN"), "fine": (0, 0, "EXCELLENT", "PASS"), "near": (0, 0, "ACCEPTABLE", "WARN"), "long": (0, 0, "CRITICAL", "FAIL"), "none": (0, 0, "EXCELLENT", "PASS")}


def test_response_metrics(spark):
    df = spark.createDataFrame([("a", 0, 200), ("a", 2, 500), ("a", 4, None), ("b", 7, 200)], "r string, s long, status int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["r"]: tuple(r)[1:] for r in logs.response_metrics(df, "r", F.col("status") < 400, "ts").collect()}
    assert got == {"a": (3, 1, 1 / 3, 4000.0, 0.75), "b": (1, 1, 1.0, 0.0, 0.0)}
