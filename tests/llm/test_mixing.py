from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing as m
from siltstone.sources.tables import table


def targets(sizes: dict) -> dict:
    """By rounds: shares by weight, excess to those below their caps."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_query_meets_the_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source")))
    rows = m.op4_query(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    sizes: dict = {}
    for r in rows:
        assert r["size"] == len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", texts[r["doc_id"]][1]) if w])
        sizes[texts[r["doc_id"]][0]] = sizes.get(texts[r["doc_id"]][0], 0) + r["size"]
    want = targets(sizes)
    for s in sizes:
        own = [r for r in rows if texts[r["doc_id"]][0] == s]
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own) / 2 + 1
    positions = [r["position"] for r in rows if r["position"] is not None]
    assert positions == sorted(positions)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, m.op4_query(docs).collect()), key=str)


def test_inverse_of_the_schedule(spark):
    for schedule in (*m.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        rows = spark.range(101).select((F.col("id") / 100).alias("x")).select("x", m.time_of_share(F.col("x"), schedule).alias("t")).collect()
        whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False))
        for r in rows:
            done = 0.0
            for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
                t = min(max(r["t"], t0), t1)
                done += (t - t0) * (a + a + (b - a) * (t - t0) / (t1 - t0)) / 2
            assert done / whole == pytest.approx(r["x"], abs=1e-6)


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, target string"
    docs = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "x y", "s", "b"), (2, "", "s", "c")], schema)
    out = m.mix_sources(docs).collect()
    assert len(out) == 4
    assert m.mix_sources(docs.limit(0)).count() == 0
    assert m.in_training_order(m.mix_sources(docs)).count() >= 1
