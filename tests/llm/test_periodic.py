from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from siltstone.llm import periodic as p
from siltstone.sources.tables import table


def smallest_period(w: list) -> int:
    """By the borders of all prefixes."""
    border = [0] * (len(w) + 1)
    border[0] = -1
    k = -1
    for i in range(len(w)):
        while k >= 0 and w[k] != w[i]:
            k = border[k]
        k += 1
        border[i + 1] = k
    return len(w) - border[len(w)]


def brute_runs(w: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // exponent + 1):
        start = 0
        while start + q < len(w):
            end = start + q
            while end < len(w) and w[end] == w[end - q]:
                end += 1
            if end - start >= max(least, exponent * q) and smallest_period(w[start:end]) == q:
                out.append((start, end - start, q))
            start = max(start + 1, end - q + 1)
    return sorted(out)


def brute_collapsed(w: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def got(df) -> dict:
    return {r["__id"]: (r["n"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect()}


def texts_with_runs(draw: random.Random, count: int) -> list[list[str]]:
    out = []
    for _ in range(count):
        w: list[str] = []
        alphabet = "ab" if draw.random() < 0.3 else [str(k) for k in range(draw.choice([3, 10, 1000]))]
        for _ in range(draw.randrange(6)):
            part = [draw.choice(alphabet) for _ in range(draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
            if draw.random() < 0.3:
                part = part[: draw.randrange(1, 4)] * draw.randrange(1, 9) + part  # a small period inside a larger one
            times = draw.choice([1, 1, 2, 3, 4, 4, 5, 9])
            w += part * times + part[: draw.randrange(len(part) + 1)]
        out.append(w)
    return out


def test_runs_match_brute_force(spark):
    texts = texts_with_runs(random.Random(5), 500)
    want = {k: (len(w), r := brute_runs(w), brute_collapsed(w, r)) for k, w in enumerate(texts)}
    assert sum(len(x[1]) for x in want.values()) > 400
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    assert got(p.periodic_runs(docs)) == want


def test_every_short_binary_text():
    for n in range(4, 15):
        texts = [[b"ab"[v >> k & 1 : (v >> k & 1) + 1] for k in range(n)] for v in range(1 << n)]
        runs, _ = p._of_texts(texts, 4, 4)
        for t, r in zip(texts, runs, strict=True):
            assert sorted(r) == brute_runs(t, 4, 4)


def test_selected_positions_are_dense_and_propose_the_period():
    draw = random.Random(2)
    for q, t in ((4, 4), (7, 4), (8, 8), (13, 8), (31, 16)):
        unit = draw.sample(range(1000), q)
        ids = np.array([5000, *(unit * 5)[: 4 * q], 5001], np.int64)
        h, k = p._mixed(ids.astype(np.uint64)), 1
        while k < t:
            h, k = p._joined(h, k), 2 * k
        i, d = p._selected_pairs(h, p._joined(h, t), np.zeros(len(h), bool), t)
        assert set(d.tolist()) == {q} and i.min() < 1 + t


def test_other_exponents(spark):
    texts = texts_with_runs(random.Random(9), 60)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    out = got(p.periodic_runs(docs, exponent=6, least_words=20))
    assert all(out[k][1] == brute_runs(w, 6, 20) for k, w in enumerate(texts))
    with pytest.raises(ValueError):
        p.find_runs(np.array([1]), np.array([0]), exponent=3)


def test_odd_rows_and_very_long_texts(spark):
    long = "x " * 300_000 + "y"
    rows = [(None, "a a a a a a", 1), (1, None, 2), (1, "", 3), (2, " \t\n", 4), (3, long, 5), (3, long, 6), (4, "É" * 9, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = sorted((str(r["__id"]), r["n"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in p.periodic_runs(docs).collect())
    one = ("3", 300_001, [(0, 300_000, 1)], "x y")
    assert out == [("1", 0, [], ""), ("1", 0, [], ""), ("2", 0, [], ""), one, one, ("4", 1, [], "É" * 9), ("None", 6, [(0, 6, 1)], "a")]
    assert p.periodic_runs(docs.limit(0)).count() == 0 and p.op13_query(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = {}
    for i, t in docs.select("doc_id", "text").collect():
        w = (t or "").encode().split()
        w, n, h = [x.decode() for x in w], len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            per = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % per] for k in range(n)]
        runs = brute_runs(w)
        top = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want[i] = (len(runs), *(top[0] if top else (None,) * 3), 1000 * top[0][1] // top[0][2] if top else None, sha(lines), sha(brute_collapsed(w, runs)))
    out = {r[0]: tuple(r)[1:8] for r in p.op13_query(docs).collect()}
    assert out == want and sum(x[0] > 0 for x in want.values()) >= 10
