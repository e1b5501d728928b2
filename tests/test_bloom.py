"""Bloom filters lose no row and keep none that is excluded."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.operators import bloom
from siltstone.sources.tables import written


@pytest.mark.parametrize(("broadcast", "blocks"), [(500_000, 1 << 20), (0, 1 << 20), (0, 64)])
def test_excluding_is_an_anti_join(spark, monkeypatch, broadcast, blocks):
    monkeypatch.setattr(bloom, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(bloom, "MOST_BLOCKS", blocks)
    df = spark.range(5000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 1000).alias("a"), F.col("id").alias("__x")).withColumnRenamed("__x", "b").unionByName(spark.createDataFrame([(None, 1), (None, 1)], "a long, b long"))
    for out in ([None, 3, 3, 7], [4], []):
        excluded = written(spark.createDataFrame([(x,) for x in out], "k long"))
        got = bloom.excluding(df, {"k": F.col("a")}, excluded)
        assert got.columns == ["a", "b"]
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if r["a"] not in out)
        there = bloom.including(df, {"k": F.col("a")}, excluded).collect()
        assert sorted(map(str, there)) == sorted(str(r) for r in df.collect() if r["a"] in out)
