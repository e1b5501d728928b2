"""Queries over records that the other modules have none for: attributes, scores, fallbacks, contracts, sinks and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import model_output as mo
from siltstone.functions import requests as rq
from siltstone.functions import scores as sc
from siltstone.functions import text as tx
from siltstone.functions import urls
from siltstone.operators import aggregates, dedup, logs, ranking, stored
from siltstone.plans.page_queries import gathered, responses
from siltstone.plans.stats_queries import AS_OF, runs
from siltstone.sources import adapters as ad
from siltstone.sources import schemas, sinks
from siltstone.sources.tables import fresh, table, written
from siltstone.streaming import streams


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _part(n: int, of: int = 10):
    """A number from 0 that the id gives."""
    return (F.col("doc_id") % n).cast("double") / F.lit(float(of))


def attributes(spark, sf_dir):
    q = ad.user_queries_t(spark, sf_dir).withColumn("category", rq.fallback_domain(F.col("raw_query")))
    a = rq.fallback_attributes(F.col("raw_query"), F.col("category"))
    tips = F.array_join(rq.suggestions(F.col("category"), (F.col("conv_id") % 10).cast("double") / F.lit(10.0)), "|")
    return q.withColumn("a", a).select("conv_id", "turn", "category", F.col("a.ai_tools.tool_type").alias("tool_type"), F.col("a.mutual_funds.investment_type").alias("investment_type"), F.col("a.general.intent").alias("intent"), tips.alias("tips"))


def result_relevance(spark, sf_dir):
    """User queries as queries and, cut, as titles and contents, on some known and unknown hosts."""
    q = ad.user_queries_t(spark, sf_dir)
    n = F.col("conv_id") % 6
    host = F.when(n == 0, "www.GitHub.com").when(n == 1, "shop.vanguard.com").when(n == 2, "mybank.org").when(n == 3, "hub.com").when(n == 4, "dev.example").otherwise("x.example")
    category = F.when(F.col("conv_id") % 3 == 0, "ai_tools").when(F.col("conv_id") % 3 == 1, "mutual_funds").otherwise("general")
    parts = (sc.url_relevance(host, category), sc.title_relevance(F.substr("raw_query", F.lit(1), F.lit(30)), F.col("raw_query"), category), sc.snippet_relevance(F.concat(F.col("raw_query"), F.lit(" model index fund")), F.col("raw_query"), category))
    out = q.select("conv_id", "turn", *[c.alias(k) for k, c in zip(("url_score", "title_score", "snippet_score"), parts, strict=True)])
    scores = [F.col(k) for k in ("url_score", "title_score", "snippet_score")]
    return out.withColumns({"overall": sc.overall_relevance(*scores), "issues": F.size(sc.relevance_issues(*scores))})


def insight_scores(spark, sf_dir):
    """T33, M5 to M8 over numbers that the ids give."""
    d = docs(spark, sf_dir)
    n, k = F.col("doc_id") % 4, F.col("doc_id") % 5
    themes = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("Tools"))).otherwise(F.array(F.lit("x"), F.col("source")))
    advice = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, n.cast("int"))
    kinds = F.slice(F.array(F.lit("Fund"), F.lit("other"), F.lit("x")), 1, n.cast("int"))
    pairs = F.map_from_entries(F.slice(F.array(*[F.struct(F.lit(str(i)).alias("k"), F.lit(i).alias("v")) for i in range(4)]), 1, k.cast("int")))
    return d.select(
        "doc_id", sc.insight_quality(themes, F.concat(F.lit("best tools "), F.col("source")), _part(11), _part(7), advice).alias("insight"), sc.structured_quality(kinds, pairs, F.when(k == 0, "mutual_funds").otherwise("ai_tools")).alias("structured"),
        mo.insight_confidence(k.cast("double"), 5, _part(11), n).alias("confidence"), mo.insight_relevance(n.cast("double"), k == 0, _part(7)).alias("relevance"),
        mo.summary_confidence(k.cast("double"), 5, F.substr("text", F.lit(1), (F.col("doc_id") % 130).cast("int")), n.cast("double")).alias("summary"),
    )


def cut_summaries(spark, sf_dir):
    cut = mo.cut_summary(F.col("text"), _part(11), 100)
    return docs(spark, sf_dir).select("doc_id", cut.alias("c")).select("doc_id", F.md5("c.text").alias("text_md5"), F.col("c.confidence").alias("confidence"), F.col("c.original_length").cast("long").alias("length"))


def messages():
    """Error messages that the id gives."""
    n = F.col("doc_id") % 6
    said = F.when(n == 0, "Bad API key of ").when(n == 1, "Quota exceeded: ").when(n == 2, "Connection refused by ").when(n == 3, "network down at ").when(n == 4, "timeout at ").otherwise("429 permission ")
    return F.concat(said, F.col("source"))


def fallbacks(spark, sf_dir):
    """What stands for rows whose processing failed."""
    d = docs(spark, sf_dir)
    r = mo.fallback_record(F.col("source"), F.col("lang"), F.col("text"), F.when(F.col("doc_id") % 3 > 0, _part(10)), messages())
    out = d.withColumns({"r": r, "a": mo.fallback_analysis(F.col("doc_id").cast("string"), messages())})
    return out.select(
        "doc_id", F.col("r.summary.executive_summary").alias("summary"), F.get("r.summary.key_points", 0).alias("point"), F.get("r.ai_insights.themes", 0).alias("theme"), F.col("r.ai_insights.confidence_score").alias("confidence"),
        F.get("r.structured_data.categories", 0).alias("category"), F.col("r.enhanced_quality_score").alias("quality"), F.get("r.processing_errors", 0).alias("error"), F.col("a.has_duplicates").alias("has_duplicates"), F.col("a.processing_metadata")["error"].alias("analysis_error"),
    )


def validated(spark, sf_dir):
    """Defaults for nulls, scores and confidences in range, no blank categories, the focus first."""
    d = docs(spark, sf_dir)
    rows = d.select(
        "doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("summary"), F.when(F.col("doc_id") % 7 > 0, _part(30) - F.lit(0.5)).alias("score"),
        F.create_map(F.lit("a"), _part(20), F.lit("b"), _part(7)).alias("confidences"), F.array(F.lit(" "), F.col("source"), F.lit("")).alias("categories"),
    )
    out = mo.focused(mo.valid_structures(mo.required(rows, {"summary": "none"}, ("score",)), "confidences", "categories"), "focus")
    return out.select("doc_id", "summary", "score", F.col("confidences")["a"].alias("a"), F.col("confidences")["b"].alias("b"), F.array_join("categories", ",").alias("categories"))


def scored(spark, sf_dir):
    """A scorer of a user's, over batches."""

    def scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": b["text"].str.len() % 100 / 100.0})

    return mo.scored_batches(docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), scorer, "doc_id bigint, score double")


def response_rows(spark, sf_dir):
    """Responses to queries: made of the query log, a part of them broken in one way or another."""
    q = ad.queries_t(spark, sf_dir)
    n = F.col("_id") % 11
    null = lambda kind: F.lit(None).cast(kind)
    query = F.struct(F.when(n != 1, F.col("query_text")).alias("text"), F.when(n == 2, "").otherwise(F.col("category")).alias("category"), F.when(n == 3, 1.5).otherwise(F.lit(0.5)).alias("confidence_score"))
    contents = F.array(F.struct(F.lit("http://a").alias("url"), F.when(n != 4, F.lit("text")).alias("content")))
    results = F.struct(F.when(n == 5, -1).otherwise(3).alias("total_items"), F.lit(2).alias("processed_items"), F.lit(0.7).alias("success_rate"), contents.alias("contents"))
    analytics = F.struct(F.lit(4).alias("pages_scraped"), F.when(n == 6, null("map<string,double>")).otherwise(F.create_map(F.lit("web_scraping"), F.lit(1.0))).alias("processing_time_breakdown"))
    timing = F.map_from_entries(F.slice(F.array(*[F.struct(F.lit(x).alias("k"), F.when(n == 7, -1.0).otherwise(F.lit(1.0)).alias("v")) for x in stored.STAGES]), 1, F.when(n == 8, 3).otherwise(4)))
    metadata = F.struct(F.col("execution_time").alias("execution_time_ms"), timing.alias("stages_timing"))
    error = F.struct(F.lit("E1").alias("code"), F.when(F.col("_id") % 2 == 0, "failed").alias("message"), F.array(F.struct(F.lit("E2").alias("error_code"), F.when(n != 9, F.lit("why")).alias("message"))).alias("details"))
    ok = F.col("status") != "failed"
    part = lambda name, x: F.when(ok, x).alias(name)
    return q.select(
        "_id", F.when(n == 10, null("string")).when(ok, "success").otherwise("error").alias("status"), part("query", query), part("results", results), part("analytics", analytics), part("execution_metadata", metadata),
        F.when(~ok, error).alias("error"),
    )


def appended(name: str, rows, time: str | None, *columns: str):
    """Rows appended to a stored table and read again."""

    def query(spark, sf_dir):
        path = fresh(spark, name)
        sinks.append(rows(spark, sf_dir), name, path, time)
        return spark.read.schema(schemas.schema(name)).parquet(path).select(*columns)

    return query


def load_tests(spark, sf_dir):
    """Each request as a run of a load test of its own, exported as JSON lines and read again."""
    path = fresh(spark, "load")
    one = F.struct("duration_ms", "status", "cache")
    sinks.export_json(ad.requests_t(spark, sf_dir).select("scenario", F.col("ts").alias("started"), F.array(one).alias("requests")), path)
    return sinks.load_tests(spark, path, lines=True).select("scenario", "request", "duration_ms", "status", "cache")


def analysed(spark, sf_dir):
    return dedup.duplicate_analysis(ad.content_t(spark, sf_dir), near=False)


def snapshots(spark, sf_dir):
    """Snapshots of resources: from the request log."""
    r = ad.requests_t(spark, sf_dir)
    return r.select("client", "ts", "event_id", F.col("duration_ms").alias("memory_mb"), (F.col("event_id") % 9).alias("open_files"), (F.col("event_id") % 7 + 3).alias("threads"))


def content_stream(spark, sf_dir):
    rows = streams.table_stream(spark, sf_dir, "doc_id bigint, text string, lang string, source string", "documents*.parquet", None)
    return rows.select(F.col("doc_id").alias("_id"), F.col("text").alias("content"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") % 3600).alias("timestamp"))


def saved_stream(spark, sf_dir):
    path = fresh(spark, "saved")
    streams.save_batches(content_stream(spark, sf_dir).select("_id", "content"), path, f"{path}-checkpoint", {"availableNow": True}).awaitTermination()
    return spark.read.parquet(path).select("_id", "content_hash", "duplicate_of")


def session_actions(spark, sf_dir):
    e = streams.event_stream(spark, sf_dir, None)
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "end").otherwise("update")
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("session_id"), "ts", F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_type") != "error").alias("ok"))


def cached_stream(spark, sf_dir):
    e = streams.event_stream(spark, sf_dir, None).select("ts", F.col("user_id").cast("string").alias("who"), F.col("event_id").alias("held"))
    return gathered(streams.cached_results(e, "who", "held", 86_400), "update").where("not expired").select("key", "value")


def idle_sessions(spark, sf_dir):
    return gathered(streams.idle_sessions(session_actions(spark, sf_dir), slot=86_400, whole=True))


QUERIES = {
    "fallback_attributes": attributes,
    "result_relevance": result_relevance,
    "insight_scores": insight_scores,
    "cut_summaries": cut_summaries,
    "error_classes": lambda s, d: docs(s, d).select("doc_id", mo.error_class(messages()).alias("class")),
    "fallback_records": fallbacks,
    "validated_records": validated,
    "batch_scores": scored,
    "salvaged_lines": lambda s, d: docs(s, d).select("doc_id", F.array_join(mo.salvaged_lines(F.col("text")), "|").alias("lines")),
    "braces": lambda s, d: responses(s, d).select("doc_id", mo.braces(F.col("raw"), 60).alias("found")),
    "metadata_fingerprint": lambda s, d: docs(s, d).select("doc_id", tx.metadata_fingerprint(F.create_map(F.lit("source"), F.coalesce("source", F.lit("")), F.lit("lang"), F.coalesce("lang", F.lit("")))).alias("fingerprint")),
    "cache_key": lambda s, d: ad.queries_t(s, d).select("_id", tx.cache_key(query=F.col("query_text"), category=F.col("category")).alias("key")),
    "response_violations": lambda s, d: stored.response_violations(response_rows(s, d), "_id"),
    "all_results": lambda s, d: ranking.all_results(ad.content_t(s, d).select(urls.domain(F.col("url")).alias("domain"), F.lit("content").alias("method"), "relevance_score"), table(s, d, "pages").select(urls.domain(F.col("url")).alias("domain"), F.lit("page").alias("method"))),
    "limited_content": lambda s, d: ranking.limited(ad.content_t(s, d).select("_id", "query_id", "timestamp"), "query_id", [F.desc("timestamp"), F.col("_id")], 50).select("_id", "query_id", "original_count", "limited"),
    "last_requests": lambda s, d: logs.last_rows(ad.requests_t(s, d).select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")]),
    "metric_counters": lambda s, d: logs.counters(ad.requests_t(s, d), "path", F.lit(1), ad.requests_t(s, d).where("path <> 'view' and event_id % 10 = 0").select("path", "ts")),
    "metric_gauges": lambda s, d: logs.gauges(ad.requests_t(s, d), "path", "duration_ms", "event_id"),
    "version_summary": lambda s, d: logs.version_summary(logs.version_metrics(runs(s, d))),
    "matched_versions": lambda s, d: logs.best_versions(logs.version_metrics(runs(s, d)), AS_OF, 5, logs.characteristics_match(F.create_map(F.lit("uses"), F.lit(100.0)), F.create_map(F.lit("uses"), F.col("uses").cast("double"), F.lit("other"), F.lit(1.0))), F.col("version_id") != "v3"),
    "overall_health": lambda s, d: aggregates.overall_health(aggregates.table_profile({"queries": ad.queries_t(s, d), "content": ad.content_t(s, d).where("_id < 0")}, ["queries", "content"], {})),
    "leak_warnings": lambda s, d: logs.leak_warnings(snapshots(s, d), "client", "ts", "event_id").where(F.size("warnings") > 0).select("event_id", F.array_join("warnings", ",").alias("warnings")),
    "large_pages": lambda s, d: stored.size_guard(table(s, d, "pages"), 2000)[1],
    "appended_queries": appended("queries", lambda s, d: ad.queries_t(s, d), "created_at", "_id", "session_id", "status", "execution_time", "result_count"),
    "appended_content": appended("content", lambda s, d: ad.content_t(s, d), "timestamp", "_id", "url", "content_type", "content_size_bytes", "timestamp", "author"),
    "appended_processed": appended("processed_content", lambda s, d: ad.processed_t(s, d), None, "original_content_id", "query_id", "processing_version", "cache_key"),
    "appended_sessions": appended("query_sessions", lambda s, d: ad.sessions_t(s, d), "start_time", "session_id", "user_id", "query_count", "failed_queries", "status"),
    "load_test_requests": load_tests,
    "exact_components": lambda s, d: analysed(s, d).select("id", "component", "group_size", "best_id", "confidence", "advice"),
    "content_with_analysis": lambda s, d: dedup.attach(ad.content_t(s, d).select("_id", "url"), written(analysed(s, d), "analysis").where("group_size > 1").select("id", "group_size", "best_id")),
    "stream_first_content": lambda s, d: gathered(streams.first_of_content(content_stream(s, d)).select("content_hash")),
    "stream_saved": saved_stream,
    "stream_sessions": lambda s, d: gathered(streams.sessions(streams.event_stream(s, d, None)), "complete").select("user_id", "start_time", "end_time", "events"),
    "stream_session_states": lambda s, d: gathered(streams.session_states(session_actions(s, d))).where("status = 'completed'"),
    "stream_session_idle": idle_sessions,
    "stream_cached": cached_stream,
}

_with = lambda *parts: "with " + ", ".join(parts)
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_any = lambda c, xs: f"len(list_filter({_list(xs)}, lambda x: contains({c}, x))) > 0"
_part_sql = lambda n, of=10: f"(cast(doc_id % {n} as double) / {float(of)}::double)"
_DOMAIN = f"case when {_any('low', rq.AI_PARTS)} then 'ai_tools' when {_any('low', rq.FUND_PARTS)} then 'mutual_funds' else 'general' end"
_OWN = f"(case category when 'ai_tools' then {_list(sc.RESULT_WORDS['ai_tools'])} when 'mutual_funds' then {_list(sc.RESULT_WORDS['mutual_funds'])} else []::varchar[] end)"
_TERMS = "list_filter(regexp_split_to_array(low, '\\s+'), lambda w: length(w) > 2)"
_near = lambda name: f"case when host in ({_list(sc.RESULT_DOMAINS[name])[1:-1]}) then 0.9::double when len(list_filter({_list(sc.RESULT_DOMAINS[name])}, lambda x: contains(host, x) or contains(x, host))) > 0 then 0.8::double when {_any('host', sc.RESULT_HINTS[name])} then 0.6::double else 0.3::double end"
_BAND = lambda c: f"case when {c} >= 0.7::double then 0.9::double when {c} >= 0.5::double then 0.6::double else 0.3::double end"
_unit = lambda c: f"least(1.0::double, greatest(0.0::double, {c}))"
_MESSAGE = "case doc_id % 6 when 0 then 'Bad API key of ' when 1 then 'Quota exceeded: ' when 2 then 'Connection refused by ' when 3 then 'network down at ' when 4 then 'timeout at ' else '429 permission ' end || source"
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_HASH = r"sha256(regexp_replace(lower(" + _TRIM.format("coalesce(text, '')") + r"), '\s+', ' ', 'g'))"
_PRINT = f"md5({_TRIM.format(f'''regexp_replace(regexp_replace(lower(content), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', '', 'g')''')})"
_ANALYSED = f"""p as (select _id, content_quality_score as q, case when coalesce(content, '') = '' then '' else {_PRINT} end as fp, url from content_t),
    g as (select _id as id, url, min(_id) over (partition by fp) as component, count(*) over (partition by fp) as group_size, first_value(_id) over (partition by fp order by coalesce(q, -1.0) desc, _id) as best_id from p)"""
_RUNS = """runs as (select category as prompt_type, 'v' || cast(_id % 4 as varchar) as version_id, case when status <> 'failed' then 1 else 0 end as success, execution_time as response_time, coalesce(quality_score, 0.0::double) as confidence, created_at from queries_t),
    m as (select prompt_type, version_id, count(*) as uses, avg(cast(success as double)) as success_rate, avg(response_time) as mean_time, coalesce(avg(confidence) filter (confidence > 0), 0.0::double) as mean_confidence, min(created_at) as created_at from runs group by all)"""

SQL = {
    "fallback_attributes": f"""{_with(ad.USER_QUERIES_SQL)}, l as (select conv_id, turn, lower(raw_query) as low from user_queries_t), c as (select *, {_DOMAIN} as category from l)
        select conv_id, turn, category, case when category = 'ai_tools' then case when {_any("low", ["image", "logo"])} then 'image generation' when {_any("low", ["text", "writing"])} then 'text generation'
        when {_any("low", ["code", "programming"])} then 'code generation' else 'general' end end as tool_type, case when category = 'mutual_funds' then case when {_any("low", ["debt", "bond"])} then 'debt'
        when {_any("low", ["hybrid", "balanced"])} then 'hybrid' else 'equity' end end as investment_type, case when category = 'general' then 'query_processing' end as intent,
        case when conv_id % 10 < 7 then '{rq.UNSURE_TIP}|' else '' end || case category when 'ai_tools' then '{"|".join(rq.TIPS["ai_tools"])}|' when 'mutual_funds' then '{"|".join(rq.TIPS["mutual_funds"])}|' else '' end || '{rq.LAST_TIP}' as tips from c""",
    "result_relevance": f"""{_with(ad.USER_QUERIES_SQL)}, l as (select conv_id, turn, lower(raw_query) as low, lower(left(raw_query, 30)) as title, lower(left(raw_query || ' model index fund', 500)) as snippet,
        case conv_id % 6 when 0 then 'github.com' when 1 then 'shop.vanguard.com' when 2 then 'mybank.org' when 3 then 'hub.com' when 4 then 'dev.example' else 'x.example' end as host,
        case conv_id % 3 when 0 then 'ai_tools' when 1 then 'mutual_funds' else 'general' end as category from user_queries_t),
        n as (select *, len(list_filter(list_distinct({_TERMS}), lambda w: contains(title, w))) + len(list_filter({_OWN}, lambda w: contains(title, w))) as t,
        coalesce(list_sum(list_transform(list_concat({_TERMS}, {_OWN}), lambda w: (length(snippet) - length(replace(snippet, w, ''))) // length(w))), 0) as k, len(list_filter(regexp_split_to_array(snippet, '\\s+'), lambda w: w <> '')) as words from l),
        s as (select conv_id, turn, case category when 'ai_tools' then {_near("ai_tools")} when 'mutual_funds' then {_near("mutual_funds")} else 0.5::double end as url_score,
        case when title = '' then 0.0::double when t >= 3 then 0.9::double when t = 2 then 0.7::double when t = 1 then 0.5::double else 0.3::double end as title_score,
        case when k / words::double > 0.1 or k >= 5 then 0.8::double when k / words::double > 0.05 or k >= 3 then 0.6::double when k / words::double > 0.02 or k >= 1 then 0.4::double else 0.2::double end as snippet_score from n)
        select *, 0.3::double * url_score + 0.3::double * title_score + 0.4::double * snippet_score as overall, (url_score < 0.5)::int + (title_score < 0.5)::int + (snippet_score < 0.5)::int as issues from s""",
    "insight_scores": f"""with d as (select *, doc_id % 4 as n, doc_id % 5 as k, length(left(text, (doc_id % 130)::int)) as l from documents)
        select doc_id, (case n when 0 then 0.0::double else 0.8::double end + {_BAND(_part_sql(11))} + {_BAND(_part_sql(7))} + case when n = 0 then 0.0::double when n >= 2 then 0.8::double else 0.5::double end) / 4.0::double as insight,
        case when n >= 3 then 0.4::double when n >= 1 then 0.2::double else 0.0::double end + case when k >= 3 then 0.3::double when k >= 1 then 0.15::double else 0.0::double end + case when k = 0 and n > 0 then 0.3::double when n > 0 then 0.1::double else 0.0::double end as structured,
        {_unit(f"0.5::double + 0.2::double * k / 5.0::double + 0.2::double * {_part_sql(11)} + least(0.1::double, 0.1::double * n)")} as confidence,
        {_unit(f"0.5::double + least(0.2::double * n, 0.3::double) + case when k = 0 then 0.1::double else 0.0::double end + 0.1::double * {_part_sql(7)}")} as relevance,
        {_unit("0.5::double + 0.2::double * k / 5.0::double + case when l > 50 then 0.1::double else 0.0::double end + case when l > 100 then 0.1::double else 0.0::double end + least(0.05::double * n, 0.2::double)")} as summary from d""",
    "cut_summaries": f"""select doc_id, md5(case when length(text) > 100 then left(text, 97) || '...' else text end) as text_md5, case when length(text) > 100 then greatest(0.1::double, 0.8::double * {_part_sql(11)}) else {_part_sql(11)} end as confidence,
        least(length(text), 100) as length from documents""",
    "error_classes": "select doc_id, case doc_id % 6 when 0 then 'auth' when 1 then 'quota' when 2 then 'connection' when 3 then 'connection' else 'other' end as class from documents",
    "fallback_records": f"""select doc_id, 'Content related to ' || source as summary, 'Content covers ' || source || ' topics' as point, 'Content related to ' || source as theme, 0.3::double as confidence, lang as category,
        case when doc_id % 3 > 0 then {_part_sql(10)} * 0.5::double else 0.0::double end as quality, {_MESSAGE} as error, false as has_duplicates, {_MESSAGE} as analysis_error from documents""",
    "validated_records": f"""select doc_id, case when doc_id % 3 > 0 then lang else 'none' end as summary, case when doc_id % 7 > 0 then {_unit(_part_sql(30) + " - 0.5::double")} else 0.5::double end as score,
        case when {_part_sql(20)} between 0.0 and 1.0 then {_part_sql(20)} else 0.5::double end as a, {_part_sql(7)} as b, 'focus,' || source as categories from documents""",
    "batch_scores": "select doc_id, length(coalesce(text, '')) % 100 / 100.0::double as score from documents",
    "salvaged_lines": r"select doc_id, array_to_string(list_slice(list_filter(list_transform(str_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s*', ''))), lambda x: length(x) > 10), 1, 5), '|') as lines from documents",
    "braces": """with b as (select doc_id, '{"id":' || doc_id || ',"title":"' || lang || '","summary":' || to_json(left(text, 40)) || '}' as body from documents),
        f as (select doc_id, case when doc_id % 5 < 3 then body end as found from b) select doc_id, case when length(found) <= 60 then found end as found from f""",
    "metadata_fingerprint": """select doc_id, md5('[{"key":"lang","value":"' || coalesce(lang, '') || '"},{"key":"source","value":"' || coalesce(source, '') || '"}]') as fingerprint from documents""",
    "cache_key": f"{_with(ad.QUERIES_SQL)} select _id, md5('category=' || category || ':query=' || query_text) as key from queries_t",
    "response_violations": f"""{_with(ad.QUERIES_SQL)}, n as (select _id, _id % 11 as n, status <> 'failed' as ok from queries_t), v as (
        select _id, 'no status' as violation from n where n = 10 union all select _id, 'no query.text' from n where ok and n = 1 union all select _id, 'empty category' from n where ok and n = 2 union all select _id, 'confidence out of range' from n where ok and n = 3
        union all select _id, 'content without url or text' from n where ok and n = 4 union all select _id, 'negative total' from n where ok and n = 5 union all select _id, 'no analytics.processing_time_breakdown' from n where ok and n = 6
        union all select _id, 'negative stage time' from n where ok and n = 7 union all select _id, 'no stage database_storage' from n where ok and n = 8
        union all select _id, 'error without code or message' from n where not ok and n <> 10 and _id % 2 <> 0 union all select _id, 'error detail incomplete' from n where not ok and n = 9) select * from v""",
    "all_results": f"""{_with(ad.CONTENT_SQL)} select lower(regexp_extract(url, '//([^/?#]*)', 1)) as domain, 'content' as method, relevance_score from content_t
        union all select lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), 'page', null from pages""",
    "limited_content": f"""{_with(ad.CONTENT_SQL)}, p as (select _id, query_id, count(*) over (partition by query_id) as original_count, row_number() over (partition by query_id order by timestamp desc, _id) as p from content_t)
        select _id, query_id, original_count, original_count > 50 as limited from p where p <= 50""",
    "last_requests": f"{_with(ad.REQUESTS_SQL)} select event_id, ts from requests_t order by ts desc, event_id desc limit 1000",
    "metric_counters": f"""{_with(ad.REQUESTS_SQL)}, r as (select path, max(ts) as reset_at from requests_t where path <> 'view' and event_id % 10 = 0 group by path)
        select q.path, count(*) filter (reset_at is null or ts >= reset_at) as value, max(reset_at) as reset_at from requests_t q left join r on q.path = r.path group by q.path""",
    "metric_gauges": f"{_with(ad.REQUESTS_SQL)} select path, arg_max(duration_ms, (ts, event_id)) as value, max(ts) as set_at from requests_t group by path",
    "version_summary": f"""{_with(ad.QUERIES_SQL, _RUNS)} select prompt_type, count(*) as versions, sum(uses)::bigint as total_uses, coalesce(sum(success_rate * uses) / sum(uses), 0.0::double) as success_rate, avg(mean_time) as mean_time, grouping(prompt_type) as all_types
        from m group by cube (prompt_type)""",
    "matched_versions": f"""{_with(ad.QUERIES_SQL, _RUNS)}, s as (select *, least(1.0::double, 0.6::double * success_rate + 0.4::double * mean_confidence + greatest(0.0::double, 1.0::double - floor((epoch_us(timestamp '{AS_OF}') - epoch_us(created_at)) / 86400000000.0::double) / 30.0::double) * 0.1::double
        + 0.2::double * case when abs(100.0::double - uses) <= 0.2::double * uses then 1.0::double else 0.0::double end) as score from m where uses >= 5 and version_id <> 'v3')
        select prompt_type, arg_max(version_id, (score, -epoch_us(created_at))) as version_id, max(score) as score from s group by prompt_type""",
    "overall_health": "select 'degraded' as status, 1::bigint as healthy, 1::bigint as degraded, 0::bigint as unhealthy from (select count(*) as n from events) where n > 0",
    "leak_warnings": f"""{_with(ad.REQUESTS_SQL)}, s as (select client, ts, event_id, duration_ms as m, event_id % 9 as f, event_id % 7 + 3 as t from requests_t),
        l as (select *, lag(m) over w as pm, lag(f) over w as pf, lag(t) over w as pt from s window w as (partition by client order by ts, event_id)),
        x as (select event_id, concat_ws(',', case when m > 1.1::double * pm then 'memory_mb' end, case when f > 1.5::double * pf then 'open_files' end, case when t > 1.2::double * pt then 'threads' end) as warnings from l) select * from x where warnings <> ''""",
    "large_pages": "select page_id, url, 'content_too_large' as error_type, octet_length(encode(html)) as size, false as retryable from pages where octet_length(encode(html)) > 2000",
    "appended_queries": f"{_with(ad.QUERIES_SQL)} select cast(_id as varchar) as _id, session_id, status, execution_time, cast(null as int) as result_count from queries_t",
    "appended_content": f"{_with(ad.CONTENT_SQL)} select cast(_id as varchar) as _id, url, content_type, content_size_bytes, timestamp, cast(null as varchar) as author from content_t",
    "appended_processed": f"{_with(ad.PROCESSED_SQL)} select cast(original_content_id as varchar) as original_content_id, cast(query_id as varchar) as query_id, processing_version, cast(null as varchar) as cache_key from processed_t",
    "appended_sessions": f"{_with(ad.SESSIONS_SQL)} select session_id, cast(user_id as varchar) as user_id, query_count::int as query_count, failed_queries::int as failed_queries, cast(null as varchar) as status from sessions_t",
    "load_test_requests": f"{_with(ad.REQUESTS_SQL)} select scenario, 0 as request, duration_ms, status, cache from requests_t",
    "exact_components": f"""{_with(ad.CONTENT_SQL, _ANALYSED)} select id, component, group_size, best_id, case when group_size > 1 then 1.0::double else 0.0::double end as confidence,
        case when group_size > 1 then 'Keep ' || best_id || ', remove others' end as advice from g""",
    "content_with_analysis": f"{_with(ad.CONTENT_SQL, _ANALYSED)} select id as _id, url, case when group_size > 1 then group_size end as group_size, case when group_size > 1 then best_id end as best_id from g",
    "stream_first_content": f"select distinct {_HASH} as content_hash from documents",
    "stream_saved": f"with h as (select doc_id as _id, {_HASH} as content_hash from documents), m as (select *, min(_id) over (partition by content_hash) as first from h) select _id, content_hash, case when _id <> first then first end as duplicate_of from m",
    "stream_sessions": """with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events), s as (select *, sum(case when before is null or ts >= before + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as n from e)
        select user_id, min(ts) as start_time, max(ts) + interval 30 minute as end_time, count(*) as events from s group by user_id, n""",
    "stream_session_states": """with e as (select cast(user_id as varchar) || '-' || cast(cast(ts as date) as varchar) as session_id, ts, event_id, event_type from events),
        s as (select *, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by session_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as n from e)
        select session_id, min(ts) as start_time, max(ts) as end_time, count(*) as actions, count(*) filter (event_type <> 'error') as successful, 'completed' as status from s group by session_id, n having bool_or(event_type = 'purchase')""",
    "stream_session_idle": """with e as (select cast(user_id as varchar) || '-' || cast(cast(ts as date) as varchar) as session_id, ts, event_id, event_type from events),
        b as (select *, case when lag(event_type) over w = 'purchase' or ts >= lag(ts) over w + interval 30 minute then 1 else 0 end as cut from e window w as (partition by session_id order by ts, event_id)),
        s as (select *, sum(cut) over (partition by session_id order by ts, event_id rows unbounded preceding) as n from b)
        select session_id, min(ts) as start_time, max(ts) as end_time, count(*) as actions, count(*) filter (event_type <> 'error') as successful,
            case when bool_or(event_type = 'purchase') then 'completed' else 'expired' end as status from s group by session_id, n""",
    "stream_cached": "select cast(user_id as varchar) as key, cast(arg_max(event_id, (ts, event_id)) as varchar) as value from events group by user_id",
}
