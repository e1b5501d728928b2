"""Literal cases of rules with fixed values: attributes of queries, relevance of results, fallbacks, answers, contracts, streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.functions import model_output as mo
from siltstone.functions import requests as rq
from siltstone.functions import scores as sc
from siltstone.operators import aggregates, logs, stored
from siltstone.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: rq.fallback_domain(F.lit("They said no")), "ai_tools"),
        (lambda: rq.fallback_domain(F.lit("A power TOOL")), "ai_tools"),
        (lambda: rq.fallback_domain(F.lit("Where to put my money")), "mutual_funds"),
        (lambda: rq.fallback_domain(F.lit("stocks and bonds")), "general"),
        (lambda: rq.fallback_attributes(F.lit("A logo from text"), F.lit("ai_tools"))["ai_tools"]["tool_type"], "image generation"),
        (lambda: rq.fallback_attributes(F.lit("programming help in writing"), F.lit("ai_tools"))["ai_tools"]["tool_type"], "text generation"),
        (lambda: rq.fallback_attributes(F.lit("chat"), F.lit("ai_tools"))["ai_tools"]["technical_expertise"], "beginner"),
        (lambda: rq.fallback_attributes(F.lit("a bond fund"), F.lit("mutual_funds"))["mutual_funds"]["investment_type"], "debt"),
        (lambda: rq.fallback_attributes(F.lit("balanced"), F.lit("mutual_funds"))["mutual_funds"]["investment_type"], "hybrid"),
        (lambda: rq.fallback_attributes(F.lit("index"), F.lit("mutual_funds"))["mutual_funds"]["investment_type"], "equity"),
        (lambda: rq.fallback_attributes(F.lit("index"), F.lit("mutual_funds"))["ai_tools"], None),
        (lambda: rq.fallback_attributes(F.lit("x"), F.lit("general"))["general"]["intent"], "query_processing"),
        (lambda: F.size(rq.suggestions(F.lit("ai_tools"), F.lit(0.5))), 4),
        (lambda: F.size(rq.suggestions(F.lit("mutual_funds"), F.lit(0.7))), 3),
        (lambda: rq.suggestions(F.lit("general"), F.lit(0.9)), ["Ask follow-up questions for more detailed information"]),
        (lambda: sc.url_relevance(F.lit("www.GitHub.com"), F.lit("ai_tools")), 0.9),
        (lambda: sc.url_relevance(F.lit("docs.github.com"), F.lit("ai_tools")), 0.8),
        (lambda: sc.url_relevance(F.lit("hub.com"), F.lit("ai_tools")), 0.8),
        (lambda: sc.url_relevance(F.lit("biotech.org"), F.lit("ai_tools")), 0.6),
        (lambda: sc.url_relevance(F.lit("mybank.net"), F.lit("mutual_funds")), 0.6),
        (lambda: sc.url_relevance(F.lit("zzz.net"), F.lit("mutual_funds")), 0.3),
        (lambda: sc.url_relevance(F.lit("zzz.net"), F.lit("general")), 0.5),
        (lambda: sc.title_relevance(F.lit("New agent model"), F.lit("an agent"), F.lit("ai_tools")), 0.9),
        (lambda: sc.title_relevance(F.lit("New thing"), F.lit("a new to do"), F.lit("general")), 0.5),
        (lambda: sc.title_relevance(F.lit("to do"), F.lit("to do"), F.lit("general")), 0.3),
        (lambda: sc.title_relevance(F.lit(""), F.lit("to do"), F.lit("general")), 0.0),
        (lambda: sc.snippet_relevance(F.lit("word " * 40 + "query"), F.lit("query it"), F.lit("general")), 0.4),
        (lambda: sc.snippet_relevance(F.lit("word " * 200 + "query"), F.lit("query"), F.lit("general")), 0.2),
        (lambda: sc.snippet_relevance(F.lit("query words"), F.lit("query"), F.lit("general")), 0.8),
        (lambda: sc.relevance_issues(F.lit(0.3), F.lit(0.9), F.lit(0.2)), ["Low URL relevance: 0.30", "Low content relevance: 0.20"]),
        (lambda: mo.error_class(F.lit("Connection lost")), "connection"),
        (lambda: mo.error_class(F.lit("timeout 429: permission")), "other"),
        (lambda: F.round(mo.insight_confidence(F.lit(10.0), 10, F.lit(0.5), F.lit(1)), 6), 0.9),
        (lambda: F.round(mo.insight_confidence(F.lit(10.0), 10, F.lit(0.5), F.lit(3)), 6), 0.9),
        (lambda: mo.fallback_record(F.lit("q"), F.lit("general"), F.lit("t"), F.lit(0.8), F.lit("e"))["enhanced_quality_score"], 0.4),
        (lambda: mo.fallback_record(F.lit("q"), F.lit("general"), F.lit("t"), F.lit(None).cast("double"), F.lit("e"))["enhanced_quality_score"], 0.0),
        (lambda: mo.fallback_summary(F.lit("q"))["key_points"], ["Content covers q topics"]),
        (lambda: mo.fallback_analysis(F.lit("1"), F.lit("bad"))["processing_metadata"]["analysis_method"], "fallback"),
        (lambda: logs.characteristics_match(F.create_map(F.lit("a"), F.lit(10.0)), F.create_map(F.lit("a"), F.lit(12.0), F.lit("b"), F.lit(1.0))), 1.0),
    ],
)
def test_columns(spark, column, want):
    assert one(spark, column()) == want


def test_balanced_json_passes_over_open_braces():
    assert mo.balanced('{ broken {"a": 1} tail') == '{"a": 1}'
    assert mo.balanced('{ one {"a": {"b": 2}} {"c": 3}') == '{"a": {"b": 2}}'
    assert mo.balanced("{" * 100_000) is None


RESULTS = f"query_id long, key long, relevance double, quality double, url string, summary string, key_points array<string>, entities {mo.ENTITY}, funds {mo.FUND}, advice array<string>"


def test_answers(spark):
    rows = [
        (1, 1, 0.9, 0.5, "u1", "A page on the topic at large.", ["Costs 5 dollars a month", "A plain long finding", "short"], [("Tool X", "ai_tool", "T", None, "100", None), ("No", "person", None, None, None, None)], None, None),
        (1, 2, 0.8, 0.5, "u1", "The best of all tools is X by far.", ["A plain long finding", "This is irrelevant stuff"], None, [("Fund Y", "FY", "0.5", None), (None, "Z", None, None)], ["Tool X - (T), Min: 100", "Another plain finding"]),
        (1, 3, 0.4, 0.5, "u2", None, None, None, None, None),
        (2, 4, 0.9, 0.5, "u3", "This does not contain an answer.", None, None, None, None),
        (3, 5, 0.2, 0.5, "u4", "Short one", ["A finding of some length"], None, None, None),
        (4, 6, 0.7, None, "", "Just so.", None, None, None, None),
        (5, 7, 0.1, None, None, "Plain.", None, None, None, None),
    ]
    got = {r["query_id"]: r for r in mo.answers(spark.createDataFrame(rows, RESULTS)).collect()}
    r = got[1]
    assert r["direct_answer"] == "The best of all tools is X by far."
    assert r["recommendations"] == ["Costs 5 dollars a month", "Tool X - (T), Min: 100", "Fund Y (FY) - Expense: 0.5"]
    assert r["findings"] == ["A plain long finding", "Another plain finding"]
    assert r["sources"] == ["u1", "u2"] and r["confidence"] == pytest.approx(0.85)
    assert (got[2]["direct_answer"], got[2]["confidence"]) == (mo.NOTHING_RELEVANT, 0.1)
    assert (got[3]["direct_answer"], got[3]["confidence"]) == ("A finding of some length", 0.1)
    assert (got[4]["direct_answer"], got[4]["confidence"], got[4]["sources"]) == ("Just so.", 0.7, [])
    assert (got[5]["direct_answer"], got[5]["recommendations"]) == ("Plain.", [])


def test_parsed_queries_tell_what_failed(spark):
    got = rq.parsed_queries(spark.createDataFrame([(1, " x "), (2, "a fine query")], "id long, q string"), "q").orderBy("id").collect()
    assert (got[0]["base_result"]["category"], got[0]["suggestions"]) == ("unknown", ["Processing failed: too_short", "Please try rephrasing your query"])
    assert (got[1]["base_result"]["category"], got[1]["reject_reason"]) == ("general", None)


def test_health_is_the_worst(spark):
    parts = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert aggregates.overall_health(parts("healthy", "degraded")).first()["status"] == "degraded"
    assert aggregates.overall_health(parts("degraded", "odd")).first()["status"] == "unhealthy"
    assert aggregates.overall_health(parts().limit(0)).first()["status"] == "healthy"


def test_percentiles_of_one_value_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("b", 7.0), ("b", None), ("c", None)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"], r["n"]) for r in logs.percentiles_linear(df, "k", "v", (50, 95)).collect()}
    assert got["a"] == (1.0, 1.0, 1) and got["b"] == (6.0, pytest.approx(6.9), 2) and "c" not in got


def test_response_contract(spark):
    schema = (
        "id long, status string, query struct<text:string,category:string,confidence_score:double>, results struct<total_items:int,processed_items:int,success_rate:double,contents:array<struct<url:string,content:string>>>, "
        "analytics struct<pages_scraped:int,processing_time_breakdown:map<string,double>>, execution_metadata struct<execution_time_ms:double,stages_timing:map<string,double>>, error struct<code:string,message:string,details:array<struct<error_code:string,message:string>>>"
    )
    stages = dict.fromkeys(stored.STAGES, 1.0)
    rows = [
        (1, "success", ("q", "general", 0.5), (1, 1, 1.0, []), (1, {}), (1.0, stages), None),
        (2, "success", ("q", "general", 2.0), (1, -1, 1.0, []), (1, {"a": -1.0}), (1.0, {"web_scraping": 1.0}), None),
        (3, "error", None, None, None, None, ("c", None, [(None, "m")])),
    ]
    got = {}
    for r in stored.response_violations(spark.createDataFrame(rows, schema), "id").collect():
        got.setdefault(r["id"], set()).add(r["violation"])
    assert got == {
        2: {"confidence out of range", "negative processed", "negative breakdown", "no stage query_processing", "no stage ai_processing", "no stage database_storage"},
        3: {"error without code or message", "error detail incomplete"},
    }
    assert stored.response_violations(spark.createDataFrame(rows[:1], schema), "id", stored=False).count() == 0


def streamed(spark, tmp_path, schema, batches, make, mode):
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(source / f"b={i}"))
    rows = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(str(source))
    name = f"t{abs(hash(str(tmp_path)))}"
    query = make(rows).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_cached_values_expire_by_event_time(spark, tmp_path):
    batches = [[("a", "1", 10), ("a", "2", 5)], [("a", "0", 1), ("b", "9", 100_000)], [("b", "9", 200_000)]]
    got = streamed(spark, tmp_path, "k string, v string, s long", batches, lambda rows: streams.cached_results(rows, "k", "v", 3600), "update")
    rows = [(r["key"], r["value"], r["expired"]) for r in got]
    assert rows[0] == ("a", "1", False) and ("a", "0", False) not in rows and ("a", None, True) in rows and rows.count(("b", "9", False)) == 2


def test_sessions_by_id_end_or_expire(spark, tmp_path):
    batches = [[("x", 1, "create", True, 10), ("x", 2, "update", False, 20), ("y", 3, "update", True, 15)], [("x", 4, "end", True, 30), ("x", 5, "update", True, 40)], [("z", 6, "create", True, 90_000)], [("z", 7, "update", True, 90_001)]]
    got = streamed(spark, tmp_path, "session_id string, seq long, action string, ok boolean, s long", batches, streams.session_states, "append")
    found = {(r["session_id"], r["actions"], r["successful"], r["status"]) for r in got}
    assert found == {("x", 3, 2, "completed"), ("x", 1, 1, "expired"), ("y", 1, 1, "expired")}
