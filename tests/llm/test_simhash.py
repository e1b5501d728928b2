from __future__ import annotations

import re

import numpy as np
import xxhash

from siltstone.llm import simhash as s
from siltstone.sources.tables import table


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for x in shingles:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for j in range(64):
            counts[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(shingles))


def components(fps: dict[int, int]) -> dict[int, int]:
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], np.uint64)
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3), strict=True):
        p, q = find(ids[a]), find(ids[b])
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir.replace("0.001", "0.01"), "documents").select("doc_id", "text").limit(500).collect()]
    rows += [(5000, None), (5001, ""), (5002, "a"), (5003, "A b"), (5004, "x\x0by z")]
    got = {r[0]: (r[1], r[2]) for r in s.op7_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: fingerprint(t) for i, t in rows}
    want = components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def near_fps() -> np.ndarray:
    draw = np.random.default_rng(1)
    fps = [int(x) for x in draw.integers(0, 2**63, 300, dtype=np.uint64)]
    for b in fps[:80]:
        c = b
        for _ in range(6):
            for _ in range(draw.integers(0, 4)):
                c ^= 1 << int(draw.integers(0, 64))
            fps.append(c)
    return np.unique(np.array(fps, np.uint64))


def test_bit_slices_find_every_pair():
    fps = near_fps()
    for radius in (1, 2, 3, 5):
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        want = {(a, b) for a, b in zip(*(v.tolist() for v in np.nonzero(near)), strict=True) if a < b}
        planes, got = s.Slices(fps), set()
        for at in range(0, len(fps), 100):
            a, b = planes.near(at, min(len(fps), at + 100), radius)
            got |= set(zip(a.tolist(), b.tolist(), strict=True))
        assert got == want


def test_tables_and_slices_lose_no_link(spark, monkeypatch):
    fps = near_fps()
    want = components({i: int(x) for i, x in enumerate(fps)})
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for bucket, size in ((1024, 1024), (1, 4)):  # few tables; many tables with buckets in slices
        monkeypatch.setattr(s, "BUCKET", bucket)
        monkeypatch.setattr(s, "SLICE", size)
        root = list(range(len(fps)))
        for r in s.links(nodes, len(fps)).collect():
            a, b = place[r["a"]], place[r["b"]]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        assert {i: find(i) for i in range(len(fps))} == want


def test_near_dedup_keeps_one_of_each_group(spark):
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(3, " ".join(words), "a"), (1, " ".join(words), "b"), (7, " ".join(words[::-1]), "c"), (None, "zz", "d")], "doc_id long, text string, fp string")
    assert sorted(r["fp"] for r in s.near_dedup(docs).collect()) == ["b", "c", "d"]
    assert s.near_dedup(docs.limit(0)).count() == 0


def test_repeated_rows_and_very_long_texts(spark):
    long = "some long text of many words " * 60_000
    docs = spark.createDataFrame([(1, long), (1, long), (2, long.upper()), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in s.op7_query(docs).collect())
    assert got[1:] == [(1, 1), (1, 1), (2, 1)] and len(got) == 4


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(5, a), (7, a.upper()), (7, b), (None, a), (None, c), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, s.near_dedup(docs).collect())) == sorted(map(str, spark.createDataFrame([(5, a), (7, b), (None, c), (5, a)], docs.schema).collect()))
