from __future__ import annotations

import duckdb

from siltstone.llm import url_filter as u
from siltstone.operators import bloom
from siltstone.sources.tables import table

URLS = [
    None, "", "no scheme", "https://A.Example.ORG/es/x", "http://example.org/en/12?q#f", "http://example.org/en/2", "https://x.com/fr/1", "https://x.com/de/1", "https://x.com/en/1?b=2&a=1&utm_source=z",
    "https://www.casino-win.net/p/", "http://m.casino-win.net/p#top", "https://notcasino.net/p", "https://casino-win.org/p", "a://b://c/d", "x://host?q", "x://host#f", "http://com/de/", "http://org",
]


def test_rules_list_and_edge_cases(spark):
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in u.op10_query(pages).collect()}
    assert len(got) == len(URLS)
    at = lambda x: got[URLS.index(x)]
    assert [(at(x)["host"], at(x)["path"], at(x)["verdict"]) for x in URLS[:3]] == [("", "", "allow")] * 3
    assert (at(URLS[3])["host"], at(URLS[3])["path"], at(URLS[3])["rule"], at(URLS[3])["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (at(URLS[4])["path"], at(URLS[4])["rule"], at(URLS[4])["verdict"]) == ("/en/12", "example.org/en/1", "block")
    assert (at(URLS[5])["rule"], at(URLS[5])["verdict"]) == ("org/", "allow")
    assert [at(x)["verdict"] for x in URLS[6:9]] == ["allow", "block", "allow"]
    assert at(URLS[8])["canonical"] == "x.com/en/1?a=1&b=2"
    assert [(at(x)["canonical"], at(x)["verdict"]) for x in URLS[9:12]] == [("casino-win.net/p", "block"), ("casino-win.net/p", "block"), ("notcasino.net/p", "allow")]
    assert (at(URLS[12])["rule"], at(URLS[12])["verdict"], at(URLS[12])["listed"]) == ("org/", "allow", True)
    assert at("http://org")["path"] == ""
    assert u.op10_query(pages.limit(0)).count() == 0


def test_bloom_filter_has_no_false_negative(spark, monkeypatch):
    pages = spark.range(20000).selectExpr("id as page_id", "concat('http://h', id % 5000, '.net/', id) as url", "id as __x").withColumnRenamed("__x", "listed")
    listed = spark.range(0, 20000, 7).selectExpr("concat('h', id % 5000, '.net/', id) as canonical")
    # a filter of some bits a key, and one that is far too small; a list that is broadcast, and one that is joined by a shuffle
    for most_blocks, most_listed in ((1 << 20, 10**6), (64, 10**6), (64, 10)):
        monkeypatch.setattr(bloom, "MOST_BLOCKS", most_blocks)
        monkeypatch.setattr(u, "BROADCAST_LISTED", most_listed)
        out = u.filter_urls(pages, listed)
        assert out.count() == 20000
        assert out.where("listed").count() == listed.count()
        assert out.where("listed and page_id % 7 > 0").count() == 0


def test_repeated_rows_and_a_given_list(spark):
    pages = spark.createDataFrame([(1, "http://a.net/p"), (1, "http://a.net/p"), (2, None), (2, None), (3, "http://b.net/" + "x" * 50_000)], "page_id long, url string")
    listed = spark.createDataFrame([("a.net/p",), ("a.net/p",), (None,)], "canonical string")
    got = sorted((r["page_id"], r["verdict"], r["listed"]) for r in u.op10_query(pages, listed).collect())
    assert got == [(1, "block", True), (1, "block", True), (2, "allow", False), (2, "allow", False), (3, "allow", False)]


def test_a_given_list_matches_sql(spark, sf_dir):
    assert u.GIVEN_LIST_SQL != u.OP10_SQL
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    rel = duck.execute(u.GIVEN_LIST_SQL)
    names = [c[0] for c in rel.description]
    out = u.given_list_query(table(spark, sf_dir, "pages")).select(*names).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, rel.fetchall())) and 0 < sum(r["listed"] for r in out) < len(out) / 2
