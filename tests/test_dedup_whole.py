"""Near duplicates are found whatever their structure: against all pairs by brute force."""

from __future__ import annotations

import random
from itertools import combinations

from siltstone.operators import dedup

CONTENT = "_id long, url string, title string, content string, content_quality_score double"


def shingles(text: str) -> set[str]:
    t = text.lower().split()
    return {" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_pairs_are_all_pairs(spark):
    draw = random.Random(3)
    word = lambda: f"w{draw.randint(0, 400)}"
    line = " ".join(f"common{i}" for i in range(12))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(draw.randint(4, 90))]
        for edits in (0, 1, 1, 2, 4):
            t = list(base)
            for _ in range(edits):
                at = draw.randint(0, len(t) - 1)
                t[at : at + draw.randint(0, 1)] = [draw.choice(["more", "one. Two", "x\n\ny", word()])]
            texts.append(" ".join(t) + (f" {line}" if draw.random() < 0.4 else ""))
    texts = list(dict.fromkeys(texts))
    c = spark.createDataFrame([(i, f"http://a.com/{i}", None, t, 0.5) for i, t in enumerate(texts)], CONTENT)
    prints = dedup.fingerprints(c)
    kept = {r["id"] for r in dedup.representatives(prints).collect()}
    for least in (0.8, 0.5):
        want = {(i, j): jaccard(texts[i], texts[j]) for i, j in combinations(sorted(kept), 2) if jaccard(texts[i], texts[j]) >= least}
        got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in dedup.near_pairs(c, prints, least).collect()}
        assert got == want and len(want) > 10


def test_an_added_word_sentence_or_blank_line_keeps_the_link(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, text), (2, text + " more"), (3, text + " Next one."), (4, text.replace("word30 ", "word30\n\n")), (5, "Other text.")]
    c = spark.createDataFrame([(i, f"http://a.com/{i}", None, t, i / 10) for i, t in rows], CONTENT)
    got = {r["id"]: (r["component"], r["group_size"], r["best_id"]) for r in dedup.duplicate_analysis(c).collect()}
    assert got == {1: (1, 4, 4), 2: (1, 4, 4), 3: (1, 4, 4), 4: (1, 4, 4), 5: (5, 1, 5)}


def test_similar_content_reads_copies_near_texts_and_urls(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, "http://a.com/1", text), (2, "http://a.com/2", text.upper()), (3, "http://a.com/3", text + " more"), (4, "http://a.com/4", "Other text."), (5, "http://a.com/4?utm_source=x", "A third text."), (6, "http://a.com/6", "No one's.")]
    c = spark.createDataFrame([(i, u, None, t, 0.5) for i, u, t in rows], CONTENT)
    ids = spark.createDataFrame([(i,) for i in range(2, 7)], "id long")
    near = 1 - 5 / (len(text) + 5)
    got = [tuple(r) for r in dedup.similar_content(c, ids, 0.3).select("id", "place", "member", "score").collect()]
    assert sorted(got) == [(2, 1, 1, 1.0), (2, 2, 3, near), (3, 1, 1, near), (3, 2, 2, near), (4, 1, 5, 0.9), (5, 1, 4, 0.9)]
    assert sorted(r["member"] for r in dedup.similar_content(c, ids, 0.3, 1).collect()) == [1, 1, 4, 5]
