from __future__ import annotations

import random
import re

import pytest

from siltstone.operators import searching as s
from siltstone.sources.tables import fresh

WORDS = "run runs running runned city cities class glass bus tested test a b c of the".split()


def brute_stem(w: str) -> str:
    if len(w) > 4 and w.endswith("ies"):
        w = w[:-3] + "y"
    if len(w) >= 4 and w[-1] == "s" and w[-2] not in "sui":
        w = w[:-1]
    for end in ("ing", "ed"):
        if w.endswith(end) and len(w) >= 3 + len(end):
            return w[: -len(end)]
    return w


def holds(ws: list[str], phrase: tuple[str, ...]) -> bool:
    return any(tuple(ws[i : i + len(phrase)]) == phrase for i in range(len(ws)))


def brute(texts: dict[int, list[str]], any_of=(), phrases=(), none_of=()) -> dict[int, int]:
    out = {}
    for i, ws in texts.items():
        stems = {brute_stem(w) for w in ws}
        matched = len({brute_stem(w) for w in any_of} & stems)
        if (all(holds(ws, p) for p in phrases) if phrases else matched) and not any(holds(ws, p) if len(p) > 1 else brute_stem(p[0]) in stems for p in none_of):
            out[i] = matched + len(phrases)
    return out


@pytest.fixture(scope="module")
def stored(spark):
    draw = random.Random(2)
    texts = {i: [draw.choice(WORDS) for _ in range(draw.randrange(12))] for i in range(300)}
    df = spark.createDataFrame([(i, " ".join(ws).title() + ".", None) for i, ws in texts.items()] + [(900, None, None), (901, "", "")], "_id long, content string, title string")
    path = fresh(spark, "postings")
    s.save_postings(s.postings(df, "_id", ["title", "content"]), path, 8)
    return path, texts


@pytest.mark.parametrize(
    "text, any_of, phrases, none_of",
    [
        ("runs CITY", ("runs", "city"), (), ()), ('"of the"', (), (("of", "the"),), ()), ('"a a"', (), (("a", "a"),), ()), ('"of the" tests "b c"', ("tests",), (("of", "the"), ("b", "c")), ()),
        ("bus -runs", ("bus",), (), (("runs",),)), ('a b -"c of" -class', ("a", "b"), (), (("c", "of"), ("class",))), ("city-test", ("city", "test"), (), ()), ("-a", (), (), ()), ('""', (), (), ()), ("absent", ("absent",), (), ()),
    ],
)
def test_searches_match_brute_force(spark, stored, text, any_of, phrases, none_of):
    path, texts = stored
    a = s.asked(text)
    assert set(a.any_of) == set(any_of) and a.phrases == phrases
    got = {r["id"]: r["matched"] for r in s.search_postings(spark, path, text, 8).collect()}
    assert got == (brute(texts, any_of, phrases, none_of) if any_of or phrases else {})


def test_stems(spark):
    words = [*WORDS, "flies", "ties", "ss", "us", "menus", "news", "ring", "sing", "string", "strings", "red", "bed", "added", "ies", "as", "lenses"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r[0]: r[1] for r in df.select("w", s.stem(df["w"])).collect()} == {w: brute_stem(w) for w in words}


def test_a_search_reads_its_buckets_alone(spark, stored):
    plan = s.search_postings(spark, stored[0], "cities", 8)._jdf.queryExecution().toString()
    assert len(set(re.findall(r"PartitionFilters: \[[^\]]*bucket#", plan))) >= 1 and "PushedFilters" in plan


def test_columns_are_not_run_together(spark):
    df = spark.createDataFrame([(1, "of", "the"), (1, "x", "y"), (2, "of the", None)], "_id long, title string, content string")
    path = fresh(spark, "postings")
    s.save_postings(s.postings(df, "_id", ["title", "content"]), path, 4)
    assert [r["id"] for r in s.search_postings(spark, path, '"of the"', 4).collect()] == [2]


def test_words_without_an_ending_are_not_searched_for_one(spark):
    from pyspark.sql import functions as F

    ws = [*WORDS, "s", "as", "ies", "flies", "us", "ing", "ring", "string", "ed", "red", "tasted", "straße", "été"]
    df = spark.createDataFrame([(w,) for w in ws], "w string").select("w", s.stem(F.col("w")).alias("stem"))
    assert {r["w"]: r["stem"] for r in df.collect()} == {w: brute_stem(w) for w in ws}
    assert "CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()
