"""Parsed pages come in small frames, however many pages a batch has."""

from __future__ import annotations

import pandas as pd

from siltstone.sources import html


def test_a_batch_of_pages_is_parsed_in_small_frames():
    pages = pd.DataFrame({"page_id": range(1050), "url": "http://a.com/x", "html": [f"<p>page {i}</p>" for i in range(1050)]})
    got = list(html.parsed_frames(iter([pages]), ["page_id", "url"], "url", "html"))
    assert max(map(len, got)) <= html.TOGETHER and pd.concat(got)["page_id"].tolist() == list(range(1050))


def test_all_pages_are_parsed(spark):
    pages = spark.range(450).selectExpr("id as page_id", "'http://a.com/x' as url", "concat('<title>t', id, '</title>') as html")
    assert sorted(r["page_id"] for r in html.parsed(pages).where("title = concat('t', page_id)").collect()) == list(range(450))
