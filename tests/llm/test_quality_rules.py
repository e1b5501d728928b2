from __future__ import annotations

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import quality_rules as q
from siltstone.sources.tables import table

ODD = [None, "", " \n\t ", "a", "a b c a b c", "x\x0by\x0cz", "é ü é ü é ü", "a b c a b c a b c", "l\nl\n l\n\n#$ #$", "w " * 120, "1 2 3 4 " * 30 + "5"]


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_counts_match_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()] + [(-i - 1, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in q.base_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_junk_is_dropped_and_clean_text_kept(spark, sf_dir):
    docs, labels = table(spark, sf_dir.replace("0.001", "0.01"), "documents"), table(spark, sf_dir.replace("0.001", "0.01"), "labels")
    out = {r["doc_id"]: r for r in q.op1_query(docs, labels).collect()}
    assert len(out) == docs.count()
    seen = [(out[r["doc_id"]], r["quality"]) for r in labels.collect() if not out[r["doc_id"]]["base_failed"]]
    good = [r["kept"] for r, quality in seen if quality == 1]
    bad = [r["kept"] for r, quality in seen if quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.3 * len(bad)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_words string, bucket int")
    trusted = spark.createDataFrame([], "doc_id long")
    assert q.quality_rules(empty, trusted).count() == 0
    one = spark.createDataFrame([(None, "a b", "x", 3), (None, "a b", "x", 3)], empty.schema)
    assert [r["n_words"] for r in q.quality_rules(one, trusted).collect()] == [2, 2]


def grams(text: str | None) -> list[int]:
    """Hashes of the words and of the pairs of neighbours."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(words, words[1:], strict=False)]
    return words + pairs


def test_ratio_and_verdict_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-1, ""), (-2, "one"), (-2, "one"), (-3, "long text " * 60_000)], "doc_id long, text string"))
    trusted = q.trusted_ids(table(spark, sf_dir, "labels"))
    good = {r["doc_id"] for r in trusted.collect()}
    buckets, prior, threshold = 256, 1000.0, -0.05
    rows = [tuple(r) for r in docs.collect()]
    raw, own = Counter(), Counter()
    for i, t in rows:
        counts = Counter(g % buckets for g in grams(t))
        raw += counts
        own += counts if i in good else Counter()
    n_raw, n_own = sum(raw.values()), sum(own.values())
    p = [(raw[b] + 0.5) / (n_raw + 0.5 * buckets) for b in range(buckets)]
    ratio = [math.log((own[b] + prior * p[b]) / (n_own + prior) / p[b]) for b in range(buckets)]
    want = []
    for i, t in rows:
        g = grams(t)
        mean = sum(ratio[x % buckets] for x in g) / len(g) if g else 0.0
        want.append((i or 0, not brute(t)[-1] and mean >= threshold, mean))
    out = q.quality_rules(docs, trusted, threshold=threshold, buckets=buckets, prior=prior).select(F.coalesce("doc_id", F.lit(0)), "kept", "ratio").collect()
    for a, b in zip(sorted(map(tuple, out)), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4)
