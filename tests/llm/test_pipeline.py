"""Each stage of the pipeline against brute force, on its own input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import language, mixing
from siltstone.sources.tables import table, written
from tests.llm.test_mixing import targets
from tests.llm.test_models import place

STAGES = dict(corpus_pipeline.STAGES)
ODD = [
    (90_001, None, None, None), (90_002, "", "en", "a"), (None, "A quick word or two about nothing", None, "b"), (None, "A quick word or two about nothing", None, "b"),
    (90_003, "Same text HERE", "en", "s1"), (90_004, "same text here", "en", None), (90_004, "same text here", "en", None), (90_005, "12 !?", "en", "s1"), (90_006, "x" * 50_000, "en", "s2"), (90_007, "one two three " * 20_000, "en", "s2"),
]


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    given = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(given.schema["n_chars"].dataType))
    more = given.unionByName(odd)
    # names that operators add
    return written(more.withColumns({"score": F.lit("s"), "size": F.lit(1), "target": F.col("doc_id"), "position": F.lit(2), "fp": F.lit(3), "n": F.lit(4), "copies": F.lit(9)}), "docs")


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def test_language_stage(spark, docs, sf_dir):
    from siltstone.llm.common import id_remainder

    out = STAGES["language"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    profiles = language.learn_profiles(docs.where(F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(False))))
    want = Counter()
    for r in docs.collect():
        lang, score = place(r["text"] or "", profiles, language.PROFILE)
        if lang != "und" and score >= language.LEAST_SCORE:
            want[tuple(r)] += 1
    assert rows(out) == want and sum(want.values()) > 150


def test_exact_dedup_stage(spark, docs, sf_dir):
    out = STAGES["exact_dedup"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    best: dict = {}
    for r in docs.collect():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        if key not in best or (r["doc_id"] is not None and (best[key]["doc_id"] is None or r["doc_id"] > best[key]["doc_id"])):
            best[key] = r
    assert rows(out) == Counter(tuple(r) for r in best.values())


def prints(text: str | None) -> int:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_dedup_stage(spark, docs, sf_dir):
    out = STAGES["near_dedup"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    given = docs.collect()
    fps = [prints(r["text"]) for r in given]
    root = list(range(len(given)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(given):
        groups[find(i)].append(r)
    want = Counter()
    for g in groups.values():
        ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
        least = min(ids) if ids else None
        want.update(tuple(r) for r in g if r["doc_id"] == least)
    assert rows(out) == want


def test_mix_stage(spark, docs, sf_dir):
    out = STAGES["mix"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    given, got = rows(docs), rows(out)
    where = {c: i for i, c in enumerate(docs.columns)}
    assert not got - Counter({k: 2 * n for k, n in given.items()})
    sizes, taken, largest = Counter(), Counter(), Counter()
    for k, n in given.items():
        s, size = k[where["source"]], len(words(k[where["text"]]))
        sizes[s] += n * size
        taken[s] += got[k] * size
        largest[s] = max(largest[s], size)
    for s, want in targets(sizes).items():
        assert abs(taken[s] - want) <= largest[s] / 2 + 1
    # the same documents as the operator takes, where rows differ in id
    mixed = mixing.mix_sources(docs.select("doc_id", "source", "text").distinct()).select("doc_id", "copies")
    assert mixed.count() == docs.select("doc_id", "source", "text").distinct().count()
    assert got == rows(STAGES["mix"](spark, docs, sf_dir))


def test_mix_stage_of_equal_rows(spark):
    """A source whose bound falls among equal rows: as many are taken as the mix takes."""
    one = spark.createDataFrame([(7, "a b c", "s", 1), (8, "d e", None, 2)], "doc_id long, text string, source string, __x int".replace("__x", "x"))
    docs = one.unionByName(spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("x")))
    got = rows(mixing.taken_rows(docs))
    assert got[(7, "a b c", "s", 1)] == pytest.approx(1.5 * 1001 - 2 / 3 + 1, abs=2) and got[(8, "d e", None, 2)] == 2
    assert mixing.taken_rows(docs.limit(0)).count() == 0


def test_pack_stage(spark, docs, sf_dir):
    twice = docs.unionByName(docs.where("doc_id = 90003"))
    out = STAGES["pack"](spark, twice, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want: Counter = Counter()
    for r in twice.collect():
        want[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got: Counter = Counter()
    places = defaultdict(list)
    for r in out:
        got[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.02 * sum(want.values()) / 2048 + 2


def test_all_stages_of_no_rows(spark, docs, sf_dir):
    for stage in STAGES.values():
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    kept = {r["doc_id"] for r in table(spark, sf_dir, "documents").select("doc_id").collect()}
    got = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert got <= kept and len(got) > 0.5 * len(kept)
