"""The query of near duplicates names each pair with its scores."""

from __future__ import annotations

import duckdb

from siltstone.plans import catalogue
from tests.test_dedup_whole import jaccard


def test_near_duplicates_names_every_pair_with_its_scores(spark, tmp_path):
    """A class of three texts, in which the first and the last are not similar, and a copy: classes leave the links open."""
    words = [f"w{i}" for i in range(90)]
    later = [*words[:30], "new", *words[31:]]
    texts = [" ".join(words), " ".join(later), " ".join([*later[:60], "other", *later[61:], "end"]), " ".join(words).upper(), "Other text.", None]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    links = [(0, 1), (1, 2)]
    assert jaccard(texts[0], texts[2]) < 0.8 <= min(jaccard(texts[a], texts[b]) for a, b in links)
    score = lambda a, b: 1 - abs(len(texts[a]) - len(texts[b])) / max(len(texts[a]), len(texts[b]))
    want = [(a, b, round(jaccard(texts[a], texts[b]), 6), round(score(a, b), 6)) for a, b in links]
    got = catalogue.queries()["near_duplicates"](spark, str(tmp_path)).select("id_a", "id_b", "jaccard", "length_score")
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(f"select id_a, id_b, jaccard, length_score from ({catalogue.oracle_sql()['near_duplicates']})").fetchall()) == want
    classes = catalogue.queries()["near_classes"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["text_id"], r["class_id"]) for r in classes) == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 0, 0), (4, 4, 4), (5, 5, 5)]
