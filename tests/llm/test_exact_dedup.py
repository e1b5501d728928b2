from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from siltstone.llm import exact_dedup as e
from siltstone.sources.tables import table


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    return sorted((i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


def result(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("__id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_groups_match_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "ÀB"), (9003, "Àb"), (9004, "àb"), (9005, rows[3][1].upper().lower())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(e.exact_groups(docs)) == brute(rows)


def test_collisions_and_huge_texts(spark):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choice("abC") for _ in range(draw.choice([0, 1, 5, 40, 41, 90])))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # primes so small that fingerprints of different texts are equal; chunks so small that texts have several; huge from 30 bytes
    assert result(e.exact_groups(docs, primes=(7, 5), chunk=8, huge=30)) == brute(rows)


def test_chunk_hashes_combine():
    h = e.Hasher(chunk=16)
    data = random.Random(2).randbytes(100)
    for k, p in enumerate(e.PRIMES):
        want = 0
        for x in data:
            want = (want * e.BASE + x) % p
        assert h.hash(data)[k] == want


def test_repeated_rows_keep_one_and_columns_stay(spark):
    rows = [(1, "A", "x"), (1, "A", "x"), (None, "a", "y"), (2, None, "z"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    kept = e.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["keep_id"]) for r in kept.collect()) == [(1, "x"), (2, "z")]
    assert e.exact_dedup(docs.limit(0)).count() == 0


def test_collisions_among_null_ids(spark):
    draw = random.Random(4)
    rows = [(None, "".join(draw.choice("ab") for _ in range(draw.choice([5, 40])))) for _ in range(60)]
    out = e.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), primes=(7, 5), chunk=8)
    want = defaultdict(int)
    for _, t in rows:
        want[hashlib.sha256(t.encode()).hexdigest()] += 1
    assert sorted((r["text_sha256"], r["group_size"]) for r in out.distinct().collect() if r["kept"]) == sorted(want.items())
    assert out.where("kept").count() == len(want) and out.count() == len(rows)
