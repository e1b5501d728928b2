"""Merged sketches stay close in every one of many periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import aggregates


def test_no_day_of_many_is_far_from_its_exact_number(spark):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 300) * 86_400)
    q = spark.range(300 * 5_000).select(F.col("id").alias("user_id"), F.col("id").cast("string").alias("session_id"), at.alias("created_at"))
    got = aggregates.merged_distinct(aggregates.distinct_sketches(q), "day").collect()
    assert len(got) == 300
    assert max(abs(r[c] / 5_000 - 1) for r in got for c in ("users_estimate", "sessions_estimate")) < 0.03
