"""The join of near pairs: what it writes, the bound from bitmaps, tiles of large groups."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from siltstone.operators import dedup, pairs
from siltstone.sources.tables import own_dir
from tests.test_dedup_whole import CONTENT, jaccard


def test_sets_of_texts_are_not_stored(spark):
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(100_000)}" for _ in range(2000)) for _ in range(200)]
    texts += [t + " more" for t in texts]
    c = spark.createDataFrame([(i, f"http://a.com/{i}", None, t, 0.5) for i, t in enumerate(texts)], CONTENT)
    here = lambda: sum(f.stat().st_size for f in Path(own_dir(spark).removeprefix("file://")).rglob("*.parquet"))
    before = here() if Path(own_dir(spark).removeprefix("file://")).exists() else 0
    assert dedup.near_pairs(c, dedup.fingerprints(c)).count() == 200
    assert here() - before < 8 * 2000 * len(texts) / 4


def test_bitmaps_bound_what_sets_share():
    draw = np.random.default_rng(1)
    for n, m, both in ((3, 3, 2), (100, 130, 90), (400, 300, 0), (5000, 4100, 4000)):
        x = draw.integers(-(2**62), 2**62, n + m - both)
        a, b = x[:n], x[n - both :]
        assert both <= pairs.most_common(pairs.bitmap(a), pairs.bitmap(b), n + m)
    assert pairs.most_common(pairs.bitmap(x[:400]), pairs.bitmap(x[400:800]), 800) < 300


def test_a_group_in_several_tiles_gives_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SLICE", 5)
    draw = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(draw.randrange(4)):
            t[draw.randrange(len(t))] = f"n{draw.randrange(1000)}"
        texts.append(" ".join(t))
    texts = list(dict.fromkeys(texts))
    c = spark.createDataFrame([(i, f"http://a.com/{i}", None, t, 0.5) for i, t in enumerate(texts)], CONTENT)
    want = {(i, j): jaccard(s, t) for i, s in enumerate(texts) for j, t in enumerate(texts) if i < j and jaccard(s, t) >= 0.8}
    got = [(r["id_a"], r["id_b"], r["jaccard"]) for r in dedup.near_pairs(c, dedup.fingerprints(c)).collect()]
    assert len(want) > 100 and sorted(got) == sorted((i, j, s) for (i, j), s in want.items())
