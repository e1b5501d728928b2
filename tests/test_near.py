"""Classes of near duplicates against all pairs, by brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from siltstone.operators import dedup, near
from tests.test_dedup_whole import CONTENT, jaccard


def classes(ids: list[int], pairs: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def edited(draw: random.Random, words: list[str], share: float) -> list[str]:
    return [draw.choice(["new", "other", w.upper()]) + str(draw.randrange(9)) if draw.random() < share else w for w in words]


def some_texts(draw: random.Random) -> list[str]:
    """Groups of near copies of all degrees, chains of edits, a passage that many share, and short texts."""
    out, passage = [], [f"p{i}" for i in range(40)]
    for k in range(4):
        base = [f"w{draw.randrange(500)}" for _ in range(draw.choice([3, 8, 40, 150]))]
        out += [" ".join(edited(draw, base, draw.choice([0.005, 0.01, 0.02, 0.05]))) for _ in range(8)]
        for _ in range(8):
            base = edited(draw, base, 0.015)
            out.append(" ".join(base + (passage if k % 3 == 0 else [])))
    return ["", "one", *out]


def test_classes_are_those_of_all_pairs(spark):
    texts = some_texts(random.Random(11))
    texts = [*texts, *texts[5:25], texts[7].upper()]
    c = spark.createDataFrame([(i, f"http://a.com/{i}", None, t, 0.5) for i, t in enumerate(texts)], CONTENT)
    prints = dedup.fingerprints(c)
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(" ".join(t.lower().split()), i)
    first = [same[" ".join(t.lower().split())] for t in texts]
    links = [(i, j) for i, j in combinations(sorted(set(first)), 2) if jaccard(texts[i], texts[j]) >= 0.8]
    want = classes(sorted(set(first)), links)
    assert 8 < len(set(want.values())) < len(want) - 8
    got = {r["id"]: (r["text_id"], r["class_id"]) for r in near.near_classes(c, prints).collect()}
    assert got == {i: (f, want[f]) for i, f in enumerate(first)}
    found = near.near_links(c, prints).collect()
    assert {(r["id_a"], r["id_b"]) for r in found} <= set(links)
    assert all(abs(r["jaccard"] - jaccard(texts[r["id_a"]], texts[r["id_b"]])) < 1e-9 for r in found)


def test_buckets_find_the_pairs_of_the_exact_join(spark):
    """The share of pairs at the threshold or above that share a bucket."""
    draw = random.Random(4)
    pairs = []
    while len(pairs) < 300:
        base = [f"w{draw.randrange(10_000)}" for _ in range(200)]
        other = edited(draw, base, 0.02)
        x, y = near.hashed_shingles([" ".join(base), " ".join(other)])
        s = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
        if 0.8 <= s < 0.85:
            pairs.append((x, y))
    found = sum(bool((near.band_keys(x) == near.band_keys(y)).any()) for x, y in pairs)
    assert found / len(pairs) >= 0.99


def test_a_large_group_has_links_as_its_rows(spark):
    draw = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, f"http://a.com/{i}", None, " ".join(edited(draw, base, 0.004)), 0.5) for i in range(300)]
    c = spark.createDataFrame([*rows, (1000, "u", None, None, 0.1), (1001, "v", None, "", 0.1)], CONTENT)
    prints = dedup.fingerprints(c)
    out = near.near_classes(c, prints).collect()
    assert {r["class_id"] for r in out if r["id"] < 1000} == {0}
    assert sorted((r["id"], r["text_id"], r["class_id"]) for r in out if r["id"] >= 1000) == [(1000, 1000, 1000), (1001, 1000, 1000)]
    assert near.near_links(c, prints).count() < 3 * 300
    assert near.near_classes(c.limit(0), dedup.fingerprints(c.limit(0))).count() == 0
    with pytest.raises(ValueError):
        near.near_links(c, prints, 0.4)


def test_words_are_those_of_split():
    draw = random.Random(3)
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = ["".join(draw.choice(["a", "B", "é", "漢", "\0", "“", "longerword", "x" * 17, *draw.sample(blanks, 4)]) for _ in range(draw.randrange(60))) for _ in range(500)]
    texts += ["", None, " ", "a\0", "a", "\0", "12345678", "123456789", "12345678\0"]
    hashes, counts = near.hashed_words(texts)
    words = [(t or "").lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    named = set(zip((w for ws in words for w in ws), hashes.tolist(), strict=True))
    assert len(named) == len({w for w, _ in named}) == len({h for _, h in named})


def test_prints_without_patterns_have_the_groups_of_fingerprints(spark):
    texts = ["One two, three.", "one  two\nthree", "onetwo three", "ONE TWO THREE!", "one two four", "É à", "é, à", "à é", "漢字", "漢 字", "漢字。", "", None, "...", " ", "K2", "K2", "x²", "x"]
    c = spark.createDataFrame([(i, "u", None, t, 0.5) for i, t in enumerate(texts)], CONTENT)
    whole = {r["id"]: r["text_fp"] for r in dedup.fingerprints(c).collect()}
    short = {r["id"]: r["text_fp"] for r in dedup.text_prints(c).collect()}
    assert short.keys() == whole.keys()
    assert all((short[a] == short[b]) == (whole[a] == whole[b]) for a, b in combinations(whole, 2))
    assert all(short[i] in (whole[i], f"#{i}") for i in whole)
    assert short[4] == "#4"


def test_two_texts_of_a_bucket_are_compared_once(spark, monkeypatch):
    """The two have been compared as a text and its lead, so there is no tile for them."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    while True:
        other = edited(draw, base, 0.025)
        x, y = near.hashed_shingles([" ".join(base), " ".join(other)])
        if 0.65 < jaccard(" ".join(base), " ".join(other)) < 0.79 and (near.band_keys(x) == near.band_keys(y)).any():
            break

    def tiles(*_):
        raise AssertionError("compared again")

    monkeypatch.setattr(near, "_tile_links", tiles)
    c = spark.createDataFrame([(1, "u", None, " ".join(base), 0.5), (2, "v", None, " ".join(other), 0.5)], CONTENT)
    assert near.near_links(c, dedup.fingerprints(c)).count() == 0
