"""Literal cases of text, URL, request, score and model-output functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.functions import model_output as mo
from siltstone.functions import requests as rq
from siltstone.functions import scores as sc
from siltstone.functions import text as tx
from siltstone.functions import urls


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: tx.clean_text(F.lit("Hello <b>world</b>.  Read our Privacy Policy now [1] {x}.")), "Hello world.. Read our  now  ."),
        (lambda: tx.clean_text(F.lit("“Hi” – it’s\r\n\r\n\r\n\r\nme")), "\"Hi\" - it's\n\nme"),
        (lambda: tx.dedup_sentences(F.lit("One two. Three four. One two. End")), "One two.. Three four.. End"),
        (lambda: tx.split_sentences(F.lit("He met Dr. Smith. Then Inc! Co A")), ["He met Dr.", "Smith.", "Then Inc!", "Co A"]),
        (lambda: tx.drop_repeated_lines(F.lit("a\na\nb\na")), "a\nb\na"),
        (lambda: tx.normalise_lines(F.lit(" a  b \n\n\n\n c")), "a b\n\nc"),
        (lambda: tx.remove_ads(F.lit("Click HERE to see sponsored news")), " to see  news"),
        (lambda: tx.truncate(F.lit("x" * 40), 20), "xxxxx... [Content truncated]"),
        (lambda: tx.truncate_bytes(F.lit("é" * 2000), 1003), "é"),
        (lambda: tx.text_fingerprint(F.lit("")), ""),
        (lambda: tx.removed_repeats(F.lit("a. b. a.")), 2),
        (lambda: tx.language_votes(F.lit("der Hund und die Katze")), "de"),
        (lambda: tx.language_votes(F.lit("xyz")), "unknown"),
        (lambda: urls.fingerprint(F.lit("HTTPS://www.Ex.com/a/?utm_source=1&b=2&a=&c=3&b=4#top")), "ex.com/a?b=2&b=4&c=3"),
        (lambda: urls.normalise(F.lit("ex.com/a")), "https://ex.com/a"),
        (lambda: urls.normalise(F.lit("ftp://ex.com")), None),
        (lambda: urls.domain(F.lit("http://A.b:80/x")), "a.b:80"),
        (lambda: rq.sanitise(F.lit("<i>a</i>\x00 ^b  c\n")), "a b c"),
        (lambda: rq.reject_reason(F.lit(" ab ")), "too_short"),
        (lambda: rq.reject_reason(F.lit("go javascript: x")), "harmful"),
        (lambda: rq.reject_reason(F.lit("a fine query")), None),
        (lambda: sc.or_half(F.lit(0.0)), 0.5),
        (lambda: sc.passes_final_filter(F.lit(600), F.lit(0.0), F.lit(None).cast("double")), True),
        (lambda: sc.passes_final_filter(F.lit(600), F.lit(0.2), F.lit(0.9)), False),
        (lambda: mo.braces(F.lit('x {"a": {"b": 1}} y'), 100), '{"a": {"b": 1}}'),
        (lambda: mo.braces(F.lit("none"), 100), None),
        (lambda: mo.salvaged_lines(F.lit("- first long line\n\n2) second long line\nshort")), ["first long line", "second long line"]),
    ],
)
def test_columns(spark, column, want):
    assert one(spark, column()) == want


def test_balanced_json():
    assert mo.balanced('x {"a": "}", "b": {}} y {') == '{"a": "}", "b": {}}'
    assert mo.balanced("{") is None
    assert mo.balanced(None) is None


def test_content_hash_ignores_case_and_spacing(spark):
    assert one(spark, tx.content_hash(F.lit("  Same   TEXT\n"))) == one(spark, tx.content_hash(F.lit("same text")))


def test_categories(spark):
    rows = [(1, "best ai machine learning tools"), (2, "low risk mutual funds for beginners"), (3, "weather tomorrow"), (4, None), (5, "aim of the mlx")]
    got = {r["id"]: (r["category"], r["needs_review"]) for r in rq.categorise(spark.createDataFrame(rows, "id int, q string"), "q").collect()}
    assert got == {1: ("ai_tools", False), 2: ("mutual_funds", False), 3: ("general", True), 4: ("general", True), 5: ("general", True)}


def test_patterns(spark):
    text = "Mail a@b.com or b@c.org, call (724) 555-3457, pay $1,200.50 or 5.5% by 2024-01-31."
    found = one(spark, tx.patterns(F.lit(text)))
    assert found["emails"] == ["a@b.com", "b@c.org"]
    assert found["prices"] == ["$1,200.50"] and found["percentages"] == ["5.5%"] and found["dates"] == ["2024-01-31"]
    assert "urls" not in found


def test_robots(spark):
    text = "User-agent: a\nUser-agent: *\nDisallow: /x # no\nDisallow:\n\nUser-agent: *\nDisallow: /y\nCrawl-delay: 3"
    rules = urls.robots_rules(spark.createDataFrame([("h.com", text)], "host string, robots string"))
    assert sorted((r["agent"], r["kind"], r["value"]) for r in rules.collect()) == [("*", "crawl-delay", "3"), ("*", "disallow", "/y"), ("a", "disallow", "/x")]
    pages = spark.createDataFrame([("http://h.com/y/1",), ("http://h.com/x",), ("http://other.com/y",)], "url string")
    assert {r["url"]: r["allowed"] for r in urls.robots_allowed(pages, rules).collect()} == {"http://h.com/y/1": False, "http://h.com/x": True, "http://other.com/y": True}


def test_robots_of_a_host_with_many_rules(spark):
    rules = spark.range(100_000).select(F.lit("h.com").alias("host"), F.lit("*").alias("agent"), F.lit("disallow").alias("kind"), F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("/x")).alias("value"))
    rows = [("http://h.com/5/x1", 1), ("http://h.com/5/y", 2), ("http://h.com/99999/x", 3), ("http://h.com", 4), ("http://h.com/5/x1", 5), (None, 6), ("http://www.h.com/7/xyz#a", 7)]
    pages = spark.createDataFrame(rows, "url string, allowed int").withColumnRenamed("allowed", "n")
    assert {r["n"]: r["allowed"] for r in urls.robots_allowed(pages, rules).collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: urls_of_www(spark)}


def urls_of_www(spark) -> bool:
    """Whether a www host is another one than that without, by the rule for domains."""
    return spark.range(1).select(urls.domain(F.lit("http://www.h.com/7")) != "h.com").first()[0]


def test_keywords_are_found_where_word_bounds_are(spark):
    parts = ["mutual fund", "mutual", "fund", "net asset value", "ai", "funds", "é", "_", "9", "́", "x"]
    joins = [" ", "  ", ",", ", ", "\n", " \n ", "-", "_", "", "\t", "'", "\U0001f600"]
    rows = [(a + j + b + k + c,) for a in parts[:6] for j in joins for b in parts for k in joins[:7] for c in parts[:4]] + [("",)]
    df = spark.createDataFrame(rows, "t string").withColumn("n", rq.keyword_text(F.col("t")))
    keywords = ["ai", "fund", "mutual fund", "net asset value", "funds"]
    got = F.array_sort(rq.keyword_hits(F.col("n"), F.split("n", " "), keywords))
    want = F.array_sort(F.array_compact(F.array(*[F.when(F.col("t").rlike(rf"(?U)\b{k}\b"), F.lit(k)) for k in keywords])))
    assert df.where(got != want).count() == 0
