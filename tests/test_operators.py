"""Literal cases of components, ranks, dedup, stored tables, ranking, pages and the pipeline."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import aggregates, dedup, logs, prefix, ranking, stored
from siltstone.operators.components import connected_components
from siltstone.plans.pipeline import PipelineConfig, process
from siltstone.sources import html
from siltstone.streaming import streams


def test_components_match_union_find(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 150), draw.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_total_and_rank_with_a_hot_key(spark):
    rows = [(i % 10 > 2 and "hot" or str(i % 10), i, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, id long, v long").withColumn("h", F.xxhash64("id"))
    got = prefix.running_total(df, ["k"], "h", ["id"], F.col("v"), 2000, "before").collect()
    for k in ("hot", "1"):
        at = 0
        for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["h"] % 2**64):
            assert r["before"] == at
            at += r["v"]
    ranked = prefix.global_rank(df.select("id"), [F.desc("id")], "place").collect()
    assert all(r["place"] == 1999 - r["id"] for r in ranked)


CONTENT = "_id long, url string, title string, content string, content_type string, content_size_bytes long, processing_time double, content_quality_score double, relevance_score double"


def content(spark, rows):
    return spark.createDataFrame([(i, u, None, t, "article", 1000, 1.0, q, 0.5) for i, u, t, q in rows], CONTENT)


def test_duplicates_keep_the_best_version(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, "http://a.com/1", text, 0.8), (2, "http://b.com/2", "Other text here.", 0.7), (3, "http://c.com/3", text.upper(), 0.9), (4, "http://a.com/1?utm_source=x", "A third text.", 0.1), (5, "http://d.com/5", text.replace("word59", "wordxx"), 0.2), (6, "http://e.com/", None, None)]
    got = {r["id"]: (r["component"], r["group_size"], r["best_id"]) for r in dedup.duplicate_analysis(content(spark, rows)).collect()}
    assert got == {1: (1, 4, 3), 3: (1, 4, 3), 4: (1, 4, 3), 5: (1, 4, 3), 2: (2, 1, 2), 6: (6, 1, 6)}
    plain = {r["id"]: r["group_size"] for r in dedup.duplicate_analysis(content(spark, rows), near=False).collect()}
    assert plain == {1: 3, 3: 3, 4: 3, 2: 1, 5: 1, 6: 1}


def test_domain_dedup_and_final_filter(spark):
    rows = [(1, "http://a.com/1", "x", 0.8), (2, "http://a.com/2", "x", 0.9), (3, "http://b.com/1", "x", 0.7)]
    assert sorted(r["_id"] for r in ranking.best_per_domain(content(spark, rows), "url", "content_quality_score", "_id").collect()) == [2, 3]


def test_saving_names_duplicates(spark):
    new = spark.createDataFrame([(1, "A  b"), (2, "a B"), (3, "c"), (4, None)], "_id long, content string")
    old = stored.save_content(spark.createDataFrame([(0, "C")], "_id long, content string"), spark.createDataFrame([], "_id long, content_hash string"))
    got = {r["_id"]: r["duplicate_of"] for r in stored.save_content(new, old).collect()}
    assert got == {1: None, 2: 1, 3: 0, 4: None}


def test_windows_with_equal_times(spark):
    rows = [(1, 0, 1), (2, 0, 1), (3, 59, 1), (4, 60, 1)]
    df = spark.createDataFrame(rows, "event_id long, s long, client long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: (r["in_window"], r["blocked"]) for r in logs.rate_limited(df, 2).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, True), 4: (2, False)}


PAGE = """<html><head><title>A  page</title><meta name="description" content="About it"><meta property="og:title" content="OG"><meta name="keywords" content="a, b">
<meta property="article:published_time" content="2024-01-02T03:04:05Z"><script>var x = "</p>";</script></head><body><nav><a href="/home">Home</a></nav>
<main><p>First paragraph of the page, which is quite long and says a thing or two about it all.</p><article><p>Second <b>bold text, left open.<p>Third one here, also with some words.</article></main>
<img src="i.png" alt="pic"><a href="http://other.org/z">Out</a><footer>foot</footer></body></html>"""


def test_page_extraction(spark):
    rows = [(1, "http://ex.com/d/p", PAGE), (2, "http://ex.com/", None), (3, "http://ex.com/", "<p>short")]
    got = {r["page_id"]: r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    r = got[1]
    assert (r["method"], r["title"], r["description"], r["keywords"], r["content_type"], r["fallback_used"]) == ("primary", "A page", "About it", ["a", "b"], "article", False)
    assert r["content"].count("Third one here") == 1 and "Home" not in r["content"] and "foot" not in r["content"]
    assert [(x["url"], x["kind"]) for x in r["links"]] == [("http://ex.com/home", "internal"), ("http://other.org/z", "external")]
    assert [(x["url"], x["alt"]) for x in r["images"]] == [("http://ex.com/d/i.png", "pic")]
    assert r["publish_date"] is not None
    assert (got[2]["content"], got[3]["content"], got[3]["method"]) == ("", "short", "minimal")


def test_structured_data_and_previews():
    page = html.parse("http://x.com", '<script type="application/ld+json">{"@graph": [{"articleBody": "body", "datePublished": "2024-01-01"}]}</script>')
    assert (page["json_text"], page["json_date"]) == ("body", "2024-01-01")
    assert html.parse(None, "<p><p><!-- <")["primary"] == ""


def test_pipeline_switches(spark):
    rows = [(1, "http://a.com/1", "Some text. It costs $5.", 0.8), (2, "http://b.com/2", "Some text. It costs $5.", 0.9), (3, "http://c.com/3", "[x] Bad.", 0.1)]
    on = process(content(spark, rows)).collect()
    assert on[0]["_id"] == 2 and on[0]["key_value_pairs"] == {"prices": ["$5"]} and on[0]["group_size"] == 2
    off = process(content(spark, rows), PipelineConfig(duplicates=False, cleaning=False, structured=False, least_quality=0.0)).collect()
    assert len(off) == 3 and off[0]["key_value_pairs"] == {}
    with pytest.raises(ValueError):
        PipelineConfig(similar=2)


def test_content_stream_saves_each_text_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "A")], "_id long, content string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("_id long, content string").parquet(source)
    q = streams.save_batches(stream, out, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {r["_id"]: r["duplicate_of"] for r in spark.read.parquet(out).collect()} == {1: None, 2: 1}


def test_small_scores_and_joins(spark):
    from siltstone.functions import scores as sc

    row = spark.range(1).select(
        sc.insight_quality(F.array(F.lit("AI tools")), F.lit("best tools"), F.lit(0.8), F.lit(0.55), F.array(F.lit("x"))).alias("i"),
        sc.structured_quality(F.array(F.lit("Fund"), F.lit("x"), F.lit("y")), F.create_map(F.lit("a"), F.lit(1)), F.lit("mutual_funds")).alias("s"),
    ).first()
    assert row["i"] == pytest.approx((0.8 + 0.9 + 0.6 + 0.5) / 4) and row["s"] == pytest.approx(0.85)
    c = content(spark, [(1, "http://a.com", "x", 0.5), (2, "http://b.com", "y", 0.5)])
    joined = dedup.attach(c, spark.createDataFrame([(1, 2)], "id long, group_size long"))
    assert sorted((r["_id"], r["group_size"]) for r in joined.collect()) == [(1, 2), (2, None)]
    assert ranking.all_results(c.select("_id"), c.select("_id", "url")).count() == 4
    assert stored.lookup(c, url="http://a.com", title=None).count() == 1


def test_the_last_change_of_a_key_counts(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "_id long, status string, t double")
    changes = spark.createDataFrame([(1, "x", 5.0, 2), (1, "y", None, 3), (1, "z", 9.0, 1), (2, None, 4.0, 1), (9, "n", 1.0, 1)], "_id long, status string, t double, at int")
    assert sorted(tuple(r) for r in stored.update(df, changes, "_id", ["status", "t"], "at").collect()) == [(1, "y", 1.0), (2, "b", 4.0), (3, "c", 3.0)]
    assert stored.update(df, changes, "_id", ["status", "t"]).count() == 3


def test_merged_sketches_stay_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 30_000).alias("user_id"), (F.col("id") % 70_001).cast("string").alias("session_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7).alias("created_at"))
    hourly = aggregates.distinct_sketches(df)
    assert hourly.select(F.max(F.octet_length("users"))).first()[0] <= 5000
    month = aggregates.merged_distinct(hourly, "year").first()
    assert abs(month["users_estimate"] - 30_000) < 0.05 * 30_000 and abs(month["sessions_estimate"] - 70_001) < 0.05 * 70_001
    assert aggregates.merged_distinct(aggregates.distinct_sketches(df.limit(0)), "day").count() == 0
