"""Queries over the stored tables and the request log, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import aggregates as a
from siltstone.operators import logs
from siltstone.sources import adapters as ad
from siltstone.sources.tables import written

AS_OF = "2024-01-30 00:00:00"

QUERIES = {
    "query_statistics": lambda s, d: a.query_statistics(ad.queries_t(s, d), "2024-01-03", "2024-01-28"),
    "popular_queries": lambda s, d: a.popular_queries(ad.queries_t(s, d), AS_OF, 20, 15),
    "content_stats": lambda s, d: a.content_stats(ad.content_t(s, d)),
    "processing_analytics": lambda s, d: a.processing_analytics(ad.processed_t(s, d)),
    "quality_distribution": lambda s, d: a.quality_distribution(ad.processed_t(s, d)),
    "usage_statistics": lambda s, d: a.usage_statistics(ad.sessions_t(s, d)),
    "popular_sessions": lambda s, d: a.popular_sessions(ad.sessions_t(s, d), AS_OF, 14, 12),
    "session_quality": lambda s, d: session_quality(s, d),
    "session_close": lambda s, d: a.close_sessions(ad.sessions_t(s, d)),
    "session_counters": lambda s, d: ad.sessions_t(s, d),
    "hourly_rollup": lambda s, d: a.period_rollup(ad.queries_t(s, d), "hour"),
    "daily_rollup": lambda s, d: a.period_rollup(ad.queries_t(s, d), "day"),
    "distinct_merged": lambda s, d: distinct_merged(s, d),
    "daily_report": lambda s, d: a.report("daily", ad.queries_t(s, d), ad.sessions_t(s, d)),
    "weekly_report": lambda s, d: a.report("weekly", ad.queries_t(s, d), ad.sessions_t(s, d)),
    "monthly_report": lambda s, d: a.report("monthly", ad.queries_t(s, d), ad.sessions_t(s, d)),
    "system_metrics": lambda s, d: system_metrics(s, d),
    "table_profile": lambda s, d: a.table_profile({"queries": ad.queries_t(s, d), "content": ad.content_t(s, d)}, ["queries", "content", "analytics"], {"content": "content_size_bytes"}),
    "endpoint_metrics": lambda s, d: logs.endpoint_metrics(ad.requests_t(s, d)),
    "histogram": lambda s, d: logs.histogram(ad.requests_t(s, d)),
    "percentiles_nearest": lambda s, d: logs.percentiles_nearest(ad.requests_t(s, d), "path", "duration_ms"),
    "percentiles_linear": lambda s, d: logs.percentiles_linear(ad.requests_t(s, d), "path", "duration_ms"),
    "loadtest_summary": lambda s, d: logs.load_summary(ad.requests_t(s, d)),
    "cache_efficiency": lambda s, d: logs.cache_efficiency(ad.requests_t(s, d)),
    "rate_limit_behaviour": lambda s, d: logs.rate_limit_behaviour(with_header(logs.rate_limited(ad.requests_t(s, d), 2, 3600)), 2),
    "memory_growth": lambda s, d: logs.memory_growth(ad.requests_t(s, d), "client", "ts", "duration_ms"),
    "pool_utilisation": lambda s, d: logs.pool_utilisation(ad.requests_t(s, d).withColumn("size", F.lit(50000.0)), "path", "duration_ms", "size"),
    "stage_status": lambda s, d: logs.stage_report(ad.requests_t(s, d), "scenario", "duration_ms", {"click": 20000.0, "view": 30000.0}, 25000.0),
    "stage_shares": lambda s, d: logs.stage_shares(ad.requests_t(s, d), "client", "duration_ms").select("event_id", "percent_of_total"),
    "response_metrics": lambda s, d: logs.response_metrics(ad.requests_t(s, d), "client", F.col("status") < 400, "ts"),
    "overall_status": lambda s, d: logs.overall_status(ad.requests_t(s, d).groupBy("client", "path").agg(F.avg("duration_ms").alias("ms")), "client", "path", "ms", {"click": 5500.0, "view": 6000.0}, 6500.0, 30000.0),
    "success_summary": lambda s, d: logs.success_summary(ad.requests_t(s, d)),
    "error_patterns": lambda s, d: logs.error_patterns(ad.requests_t(s, d)),
    "rate_limited_requests": lambda s, d: logs.rate_limited(ad.requests_t(s, d), 3, 3600).select("event_id", "in_window", "blocked"),
    "key_allowed": lambda s, d: logs.key_allowed(ad.requests_t(s, d), 3, 3600).select("event_id", "allowed"),
    "polite_schedule": lambda s, d: logs.polite_schedule(ad.requests_t(s, d), "client", 7200.0).select("event_id", F.round("start", 3).alias("start"), F.round("wait", 3).alias("wait")),
    "degradation": lambda s, d: logs.degradation(ad.requests_t(s, d), "path", "duration_ms"),
    "leak_lag": lambda s, d: logs.leaks(ad.requests_t(s, d), "client", "ts", "event_id", "duration_ms").select("event_id", "before", "leak"),
    "baseline_compare": lambda s, d: logs.compare_averages(*halves(s, d), "scenario", "duration_ms"),
    "stage_compare": lambda s, d: logs.compare_stages(*halves(s, d), "client", "duration_ms"),
    "advice": lambda s, d: advice(ad.requests_t(s, d)),
    "version_metrics": lambda s, d: logs.version_metrics(runs(s, d)),
    "best_versions": lambda s, d: logs.best_versions(logs.version_metrics(runs(s, d)), AS_OF),
}


def session_quality(spark, sf_dir):
    """A9 on averages that do not depend on how the log is split."""
    q = ad.queries_t(spark, sf_dir)
    return a.session_quality(a.averages_in_order(ad.session_counters(q), q))


def distinct_merged(spark, sf_dir):
    """By day and month the exact numbers of users and sessions, and whether hourly sketches, stored and merged, come within 5 percent."""
    q = ad.queries_t(spark, sf_dir)
    hourly, out = written(a.distinct_sketches(q), "sketches"), None
    for unit in ("day", "month"):
        exact = a.period_rollup(q, unit).select("period_start", "unique_users", "unique_sessions")
        near = lambda e, x: F.abs(F.col(e) - F.col(x)) <= F.greatest(F.lit(1.0), 0.05 * F.col(x))
        one = exact.join(a.merged_distinct(hourly, unit), "period_start").select(F.lit(unit).alias("unit"), "period_start", "unique_users", "unique_sessions", (near("users_estimate", "unique_users") & near("sessions_estimate", "unique_sessions")).alias("estimated_well"))
        out = one if out is None else out.unionByName(one)
    return out


def halves(spark, sf_dir):
    """The request log before and from mid-January on: all rows."""
    r = ad.requests_t(spark, sf_dir)
    middle = F.lit("2024-01-15").cast("timestamp")
    return r.where(F.col("ts") < middle), r.where(F.col("ts") >= middle)


def with_header(flagged):
    """What the answer's header says is left: right, but in every seventh answer one too many, and absent in every ninth."""
    left = F.greatest(F.lit(0), F.lit(2) - F.col("in_window"))
    return flagged.withColumn("remaining", F.when(F.col("event_id") % 9 > 0, left + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)))


def advice(requests):
    memory = logs.memory_growth(requests, "client", "ts", "duration_ms")
    return logs.advice(requests, memory, logs.pool_utilisation(requests.withColumn("size", F.lit(50000.0)), "path", "duration_ms", "size"))


def runs(spark, sf_dir):
    """Runs of prompt versions: from queries."""
    q = ad.queries_t(spark, sf_dir)
    return q.select(F.col("category").alias("prompt_type"), F.concat(F.lit("v"), (F.col("_id") % 4).cast("string")).alias("version_id"), (F.col("status") != "failed").cast("int").alias("success"), F.col("execution_time").alias("response_time"), F.coalesce("quality_score", F.lit(0.0)).alias("confidence"), "created_at")


def system_metrics(spark, sf_dir):
    """Usage, content and processing statistics, in rows of one name and value each."""
    frames = {"usage": a.usage_statistics(ad.sessions_t(spark, sf_dir)), "content": a.content_stats(ad.content_t(spark, sf_dir)).drop("content_types"), "processing": a.processing_analytics(ad.processed_t(spark, sf_dir)).drop("versions")}
    out = None
    for kind, df in frames.items():
        rows = df.select(F.inline(F.array(*[F.struct(F.lit(f"{kind}.{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])))
        out = rows if out is None else out.unionByName(rows)
    return out


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts)


_avg0 = lambda c: f"case when count(*) = 0 then 0.0::double else avg({c}) end"
_A1 = f"""count(*) as total_queries, count(*) filter (status = 'completed') as completed_queries, count(*) filter (status = 'failed') as failed_queries,
  {_avg0("execution_time")} as average_execution_time, coalesce(sum(execution_time), 0.0::double) as total_execution_time, {_avg0("quality_score")} as average_quality_score"""
_ROLLUP = """count(*) as total_queries, count(*) filter (status = 'completed') as successful_queries, count(*) filter (status = 'failed') as failed_queries,
  count(distinct user_id) as unique_users, count(distinct session_id) as unique_sessions, avg(quality_score) as average_quality_score"""
_IN_WINDOW = """counted as (select *, count(*) over (partition by client order by epoch_us(ts) range between 3599999999 preceding and current row)
  - (count(*) over (partition by client, ts) - row_number() over (partition by client, ts order by event_id)) as in_window from requests_t)"""
_HALVES = "base as (select * from requests_t where ts < timestamp '2024-01-15'), now as (select * from requests_t where ts >= timestamp '2024-01-15')"
_RUNS = """runs as (select category as prompt_type, 'v' || cast(_id % 4 as varchar) as version_id, case when status <> 'failed' then 1 else 0 end as success, execution_time as response_time,
  coalesce(quality_score, 0.0::double) as confidence, created_at from queries_t), metrics as (
  select prompt_type, version_id, count(*) as uses, avg(cast(success as double)) as success_rate, avg(response_time) as mean_time,
    coalesce(avg(confidence) filter (confidence > 0), 0.0::double) as mean_confidence, max(created_at) as last_used, min(created_at) as created_at from runs group by all)"""
_CACHE = """cached as (select scenario, count(*) filter (cache = 'HIT') as hits, count(*) filter (cache <> 'HIT') as misses, avg(duration_ms) filter (cache = 'HIT') as hit_ms,
  avg(duration_ms) filter (cache <> 'HIT') as miss_ms from requests_t group by scenario)"""
_DEGRADED = """placed as (select path, scenario, duration_ms, row_number() over (partition by path order by ts, event_id) <= floor(count(*) over (partition by path) / 2) as first from requests_t),
 halved as (select path, avg(duration_ms) filter (first) as first_half, avg(duration_ms) filter (not first) as second_half from placed group by path),
 degraded as (select *, case when first_half > 0 then 100.0::double * (second_half - first_half) / first_half else 0.0::double end as change_percent from halved)"""
_STAGES = """stats as (select scenario, count(*) as n, min(duration_ms) as least, max(duration_ms) as most, avg(duration_ms) as mean, quantile_cont(duration_ms, 0.5) as median, quantile_cont(duration_ms, 0.95) as p95,
  case scenario when 'click' then 20000.0::double when 'view' then 30000.0::double else 25000.0::double end as "limit" from requests_t group by scenario)"""
_BUCKETS = ", ".join(f"({b}::double)" for b in logs.BUCKETS)
_SYSTEM = [("usage", "total_sessions", "count(*)", "sessions_t"), ("usage", "unique_users", "count(distinct user_id)", "sessions_t"), ("usage", "total_queries", "sum(query_count)", "sessions_t"), ("usage", "successful_queries", "sum(successful_queries)", "sessions_t"), ("usage", "failed_queries", "sum(failed_queries)", "sessions_t"), ("usage", "total_processing_time", "sum(total_processing_time)", "sessions_t"), ("usage", "average_quality_score", "avg(average_quality_score)", "sessions_t"), ("content", "total_content", "count(*)", "content_t"), ("content", "total_size_bytes", "sum(content_size_bytes)", "content_t"), ("content", "average_processing_time", "avg(processing_time)", "content_t"), ("content", "average_quality_score", "avg(content_quality_score)", "content_t"), ("content", "average_relevance_score", "avg(relevance_score)", "content_t"), ("content", "unique_domains", "count(distinct nullif(regexp_extract(url, 'https?://([^/]+)', 0), ''))", "content_t"), ("processing", "total_processed", "count(*)", "processed_t"), ("processing", "average_duration", "avg(processing_duration)", "processed_t"), ("processing", "total_duration", "sum(processing_duration)", "processed_t"), ("processing", "average_quality_score", "avg(enhanced_quality_score)", "processed_t"), ("processing", "total_errors", "sum(len(processing_errors))", "processed_t")]

SQL = {
    "query_statistics": f"{_with(ad.QUERIES_SQL)} select {_A1} from queries_t where created_at >= timestamp '2024-01-03' and created_at <= timestamp '2024-01-28'",
    "popular_queries": f"""{_with(ad.QUERIES_SQL)} select query_text, count(*) as count, avg(quality_score) as avg_quality, avg(execution_time) as avg_execution_time, max(created_at) as last_executed
        from queries_t where created_at >= timestamp '{AS_OF}' - interval 20 day group by query_text order by count(*) desc, query_text limit 15""",
    "content_stats": f"""{_with(ad.CONTENT_SQL)} select count(*) as total_content, coalesce(sum(content_size_bytes), 0)::bigint as total_size_bytes, {_avg0("processing_time")} as average_processing_time,
        {_avg0("content_quality_score")} as average_quality_score, {_avg0("relevance_score")} as average_relevance_score,
        count(distinct nullif(regexp_extract(url, 'https?://([^/]+)', 0), '')) as unique_domains, string_agg(distinct content_type, ',' order by content_type) as content_types from content_t""",
    "processing_analytics": f"""{_with(ad.PROCESSED_SQL)} select count(*) as total_processed, {_avg0("processing_duration")} as average_duration, coalesce(sum(processing_duration), 0.0::double) as total_duration,
        {_avg0("enhanced_quality_score")} as average_quality_score, coalesce(sum(len(processing_errors)), 0)::bigint as total_errors, string_agg(distinct processing_version, ',') as versions from processed_t""",
    "quality_distribution": f"""{_with(ad.PROCESSED_SQL)} select case when enhanced_quality_score is null or enhanced_quality_score < 0.3::double then 'low' when enhanced_quality_score < 0.7::double then 'medium' else 'high' end as quality_band,
        count(*) as count from processed_t group by 1""",
    "usage_statistics": f"""{_with(ad.SESSIONS_SQL)} select count(*) as total_sessions, count(distinct user_id) as unique_users, coalesce(sum(query_count), 0)::bigint as total_queries, coalesce(sum(successful_queries), 0)::bigint as successful_queries,
        coalesce(sum(failed_queries), 0)::bigint as failed_queries, coalesce(sum(total_processing_time), 0.0::double) as total_processing_time, {_avg0("average_quality_score")} as average_quality_score from sessions_t""",
    "popular_sessions": f"""{_with(ad.SESSIONS_SQL)} select session_id, sum(query_count)::bigint as total_queries, avg(average_quality_score) as avg_quality, sum(total_processing_time) as total_time from sessions_t
        where start_time >= timestamp '{AS_OF}' - interval 14 day group by session_id order by 2 desc, 1 limit 12""",
    "session_quality": f"""{_with(ad.SESSIONS_SQL)} select count(*) filter (average_quality_score >= 0.7::double) as high_quality, count(*) filter (average_quality_score >= 0.4::double and average_quality_score < 0.7::double) as medium_quality,
        count(*) filter (average_quality_score is null or average_quality_score < 0.4::double) as low_quality, {_avg0("average_quality_score")} as average_quality, count(*) as total_sessions from sessions_t""",
    "session_close": f"""{_with(ad.SESSIONS_SQL)} select session_id, (epoch_us(end_time) - epoch_us(start_time)) / 1e6::double as duration_seconds, case when query_count > 0 then total_processing_time / query_count end as average_query_time,
        'completed' as status from sessions_t""",
    "session_counters": f"{_with(ad.SESSIONS_SQL)} select * from sessions_t",
    "hourly_rollup": f"{_with(ad.QUERIES_SQL)} select date_trunc('hour', created_at)::timestamp as period_start, {_ROLLUP} from queries_t group by 1",
    "distinct_merged": f"""{_with(ad.QUERIES_SQL)} select unit, date_trunc(unit, created_at)::timestamp as period_start, count(distinct user_id) as unique_users, count(distinct session_id) as unique_sessions, true as estimated_well
        from queries_t, (values ('day'), ('month')) u(unit) group by 1, 2""",
    "daily_rollup": f"{_with(ad.QUERIES_SQL)} select date_trunc('day', created_at)::timestamp as period_start, {_ROLLUP} from queries_t group by 1",
    "daily_report": f"""{_with(ad.SESSIONS_SQL)}, days as (select created_at::date as day, count(*) as total_queries, count(*) filter (status = 'failed') as failed_queries from queries_t group by 1),
        users as (select start_time::date as day, count(distinct user_id) as unique_users, count(*) as sessions from sessions_t group by 1)
        select d.day, total_queries, failed_queries, unique_users, sessions from days d left join users u on d.day = u.day""",
    "weekly_report": f"""{_with(ad.QUERIES_SQL)}, daily as (select date_trunc('day', created_at)::timestamp as period_start, {_ROLLUP} from queries_t group by 1)
        select date_trunc('week', period_start)::timestamp as week, sum(total_queries)::bigint as total_queries, avg(average_quality_score) as average_quality,
        array_to_string(list_sort(list(distinct unique_users)), ',') as daily_users from daily group by 1""",
    "monthly_report": f"""{_with(ad.QUERIES_SQL)}, daily as (select date_trunc('day', created_at)::timestamp as period_start, {_ROLLUP} from queries_t group by 1),
        parts as (select date_trunc('day', created_at)::timestamp as period_start, category, count(*) as n from queries_t group by 1, 2),
        last as (select date_trunc('month', period_start)::timestamp as month, category, arg_max(n, period_start) as n from parts group by 1, 2)
        select date_trunc('month', period_start)::timestamp as month, sum(total_queries)::bigint as total_queries, avg(average_quality_score) as average_quality, count(*) as periods,
        (select string_agg(category || '=' || n, ',' order by category || '=' || n) from last l where l.month = date_trunc('month', d.period_start)) as category_breakdown from daily d group by 1, 5""",
    "system_metrics": f"with {ad.SESSIONS_SQL}, {ad.PROCESSED_SQL} " + " union all ".join(f"select '{k}.{n}' as metric, cast({e} as double) as value from {t}" for k, n, e, t in _SYSTEM),
    "table_profile": f"""with {ad.QUERIES_SQL}, {ad.CONTENT_SQL} select 'queries' as "table", count(*) as rows, cast(null as double) as average_size, case when count(*) = 0 then 'degraded' else 'healthy' end as status, count(*) > 0 as has_sample from queries_t
        union all select 'content', count(*), avg(content_size_bytes)::double, case when count(*) = 0 then 'degraded' else 'healthy' end, count(*) > 0 from content_t union all select 'analytics', null, null, 'unhealthy', false""",
    "endpoint_metrics": f"""{_with(ad.REQUESTS_SQL)} select path, count(*) as requests, sum(duration_ms) as total_ms, avg(duration_ms) as average_ms, min(duration_ms) as least_ms, max(duration_ms) as most_ms,
        count(*) filter (status >= 400) as errors, count(*) filter (status >= 400 and status < 500) as client_errors, count(*) filter (status >= 500) as server_errors,
        count(*) filter (cache = 'HIT') as cache_hits, count(*) filter (cache = 'MISS') as cache_misses, count(*) filter (duration_ms > 5000) as slow from requests_t group by path""",
    "histogram": f"""{_with(ad.REQUESTS_SQL)}, bounds(le) as (values {_BUCKETS}, (null)), paths as (select path, sum(duration_ms / 1000.0::double) as total_seconds from requests_t group by path)
        select p.path, p.total_seconds, b.le, (select count(*) from requests_t r where r.path = p.path and (b.le is null or r.duration_ms / 1000.0::double <= b.le)) as count from paths p, bounds b""",
    "percentiles_nearest": f"""{_with(ad.REQUESTS_SQL)}, s as (select path, list_sort(list(duration_ms)) as v, count(*) as n from requests_t group by path)
        select path, {", ".join(f"v[least(floor(n * {p} / 100)::bigint, n - 1) + 1] as p{p}" for p in (50, 95, 99))}, n from s""",
    "percentiles_linear": f"{_with(ad.REQUESTS_SQL)} select path, {', '.join(f'quantile_cont(duration_ms, {p / 100}) as p{p}' for p in (50, 90, 95, 99))}, count(duration_ms) as n from requests_t group by path",
    "loadtest_summary": f"""{_with(ad.REQUESTS_SQL)} select scenario, count(*) as requests, 100.0::double * count(*) filter (status < 400) / count(*) as success_rate, min(duration_ms) as least_ms, max(duration_ms) as most_ms, avg(duration_ms) as average_ms,
        quantile_cont(duration_ms, 0.5) as p50, quantile_cont(duration_ms, 0.95) as p95, 100.0::double * count(*) filter (cache = 'HIT') / count(*) as cache_hit_rate, 100.0::double * count(*) filter (status = 429) / count(*) as throttled_rate
        from requests_t group by scenario""",
    "cache_efficiency": f"""{_with(ad.REQUESTS_SQL, _CACHE)} select *, 100.0::double * hits / (hits + misses) as hit_rate, miss_ms / nullif(hit_ms, 0) as speed_up, 100.0::double * hits / (hits + misses) < 50 as low_hit_rate,
        hit_ms > 0.8::double * miss_ms as slow_hits from cached""",
    "rate_limit_behaviour": f"""{_with(ad.REQUESTS_SQL, _IN_WINDOW)} select client, count(*) as sent, count(*) filter (in_window > 2) as blocked, 100.0::double * count(*) filter (in_window > 2) / count(*) as block_rate, 0::bigint as passed_over_limit,
        count(*) filter (event_id % 9 = 0 or event_id % 7 = 0) as header_failures from counted group by client""",
    "memory_growth": f"""{_with(ad.REQUESTS_SQL)}, g as (select client, arg_min(duration_ms, (ts, duration_ms)) as start_mb, arg_max(duration_ms, (ts, duration_ms)) as end_mb, max(duration_ms) as peak_mb, min(duration_ms) as least_mb, avg(duration_ms) as average_mb,
        count(*) as samples from requests_t group by client)
        select *, (end_mb - start_mb) / samples as growth_per_request, (end_mb - start_mb) / samples * 100 > 10 as leak, peak_mb > 1000 as high_peak from g""",
    "pool_utilisation": f"""{_with(ad.REQUESTS_SQL)}, g as (select path, avg(100.0::double * duration_ms / 50000.0::double) as average_percent, max(100.0::double * duration_ms / 50000.0::double) as most_percent,
        count(*) filter (100.0::double * duration_ms / 50000.0::double > 80) as saturated_samples from requests_t group by path) select *, most_percent > 80 as saturated from g""",
    "stage_status": f"""{_with(ad.REQUESTS_SQL, _STAGES)}, o as (select r.scenario, count(*) as outliers from requests_t r join stats s on r.scenario = s.scenario where r.duration_ms > s.p95 group by 1)
        select s.scenario, n, least, most, mean, median, p95, coalesce(outliers, 0) as outliers, "limit", mean > 0.8::double * "limit" as mean_near_limit, most > "limit" as most_over_limit,
        case when mean / "limit" < 0.5 then 'EXCELLENT' when mean / "limit" < 0.8 then 'GOOD' when mean / "limit" < 1.0 then 'ACCEPTABLE' when mean / "limit" < 1.2 then 'SLOW' else 'CRITICAL' end as status
        from stats s left join o on s.scenario = o.scenario""",
    "stage_shares": f"{_with(ad.REQUESTS_SQL)}, t as (select *, sum(duration_ms) over (partition by client) as total from requests_t) select event_id, case when total > 0 then 100.0::double * duration_ms / total else 0.0::double end as percent_of_total from t",
    "success_summary": f"{_with(ad.REQUESTS_SQL)} select count(*) as total, count(*) filter (status < 400) as successful, count(*) filter (status >= 400) as failed, round_even(count(*) filter (status < 400) / count(*)::double, 3) as success_rate from requests_t",
    "error_patterns": f"""{_with(ad.REQUESTS_SQL)}, e as (select *, row_number() over (partition by path order by event_id) as rank from requests_t where status >= 400)
        select path, count(*) as errors, count(distinct client) as sites, string_agg(cast(event_id as varchar), ',' order by event_id) filter (rank <= 3) as examples,
        (select count(*) filter (status < 400) / count(*)::double from requests_t) as overall_success_rate from e group by path""",
    "response_metrics": f"""{_with(ad.REQUESTS_SQL)}, g as (select client, count(*) as items_processed, count(*) filter (status < 400) as items_successful, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::double as execution_ms from requests_t group by client)
        select client, items_processed, items_successful, items_successful / items_processed::double as success_rate, execution_ms, case when execution_ms > 0 then items_processed / (execution_ms / 1000.0::double) else 0.0::double end as items_per_second from g""",
    "overall_status": f"""{_with(ad.REQUESTS_SQL)}, t as (select client, path, avg(duration_ms) as ms from requests_t group by client, path),
        l as (select *, ms / case path when 'click' then 5500.0::double when 'view' then 6000.0::double else 6500.0::double end as share from t),
        g as (select client, sum(ms) as total, count(*) filter (share >= 1.0 and share < 1.2) as slow, count(*) filter (share >= 1.2) as critical, sum(ms) / 30000.0::double as share from l group by client)
        select client, total, slow, critical, case when share < 0.5 then 'EXCELLENT' when share < 0.8 then 'GOOD' when share < 1.0 then 'ACCEPTABLE' when share < 1.2 then 'SLOW' else 'CRITICAL' end as total_status,
          case when critical > 0 then 'FAIL' when slow > 0 then 'WARN' when share >= 1.2 then 'FAIL' when share >= 0.8 then 'WARN' else 'PASS' end as overall from g""",
    "rate_limited_requests": f"{_with(ad.REQUESTS_SQL, _IN_WINDOW)} select event_id, in_window, in_window > 3 as blocked from counted",
    "key_allowed": f"{_with(ad.REQUESTS_SQL, _IN_WINDOW)} select event_id, in_window - 1 < 3 as allowed from counted",
    "polite_schedule": f"""{_with(ad.REQUESTS_SQL)}, a as (select event_id, client, ts, epoch_us(ts) / 1e6::double as arrival, 7200.0::double * (row_number() over (partition by client order by ts, event_id) - 1) as before from requests_t),
        b as (select *, before + max(arrival - before) over (partition by client order by ts, event_id rows unbounded preceding) as start from a)
        select event_id, round(start, 3) as start, round(start - arrival, 3) as wait from b""",
    "degradation": f"{_with(ad.REQUESTS_SQL, _DEGRADED)} select *, change_percent > 20 as degraded from degraded",
    "leak_lag": f"""{_with(ad.REQUESTS_SQL)}, l as (select *, lag(duration_ms) over (partition by client order by ts, event_id) as before from requests_t)
        select event_id, before, coalesce(duration_ms > 1.1::double * before, false) as leak from l""",
    "baseline_compare": f"""{_with(ad.REQUESTS_SQL, _HALVES)}, b as (select scenario, avg(duration_ms) as baseline from base group by 1), c as (select scenario, avg(duration_ms) as current from now group by 1),
        j as (select coalesce(b.scenario, c.scenario) as scenario, baseline, current, case when baseline > 0 and current > 0 then 100.0::double * (current - baseline) / baseline end as change_percent from b full join c on b.scenario = c.scenario)
        select *, case when change_percent > 20 then 'regression' when change_percent < -20 then 'improvement' when change_percent is not null then 'unchanged' else 'missing' end as verdict from j""",
    "stage_compare": f"""{_with(ad.REQUESTS_SQL, _HALVES)}, b as (select client, sum(duration_ms) as baseline from base group by 1), c as (select client, sum(duration_ms) as current from now group by 1),
        j as (select coalesce(b.client, c.client) as client, coalesce(baseline, 0.0::double) as baseline, coalesce(current, 0.0::double) as current from b full join c on b.client = c.client)
        select *, current - baseline as difference, case when baseline > 0 then 100.0::double * (current - baseline) / baseline when current > 0 then 100.0::double else 0.0::double end as change_percent from j""",
    "advice": f"""{_with(ad.REQUESTS_SQL, _CACHE, _DEGRADED)} select path as scenario, 'degradation' as finding from degraded where change_percent > 20
        union all select scenario, 'low cache hit rate' from cached where 100.0::double * hits / (hits + misses) < 50
        union all select scenario, 'cache hits are slow' from cached where hit_ms > 0.8::double * miss_ms
        union all select scenario, 'failures' from requests_t group by scenario having 100.0::double * count(*) filter (status < 400) / count(*) < 95
        union all select r.scenario, 'many outliers' from requests_t r join (select scenario, quantile_cont(duration_ms, 0.95) as p95 from requests_t group by 1) p on r.scenario = p.scenario group by 1 having count(*) filter (duration_ms > p95) * 10 > count(*)
        union all select cast(client as varchar), 'memory leak' from requests_t group by client having (arg_max(duration_ms, (ts, duration_ms)) - arg_min(duration_ms, (ts, duration_ms))) / count(*) * 100 > 10
        union all select path, 'pool saturated' from requests_t group by path having max(100.0::double * duration_ms / 50000.0::double) > 80""",
    "version_metrics": f"{_with(ad.QUERIES_SQL, _RUNS)} select * from metrics",
    "best_versions": f"""{_with(ad.QUERIES_SQL, _RUNS)}, scored as (select *, least(1.0::double, 0.6::double * success_rate + 0.4::double * mean_confidence +
        greatest(0.0::double, 1.0::double - floor((epoch_us(timestamp '{AS_OF}') - epoch_us(created_at)) / 86400000000.0::double) / 30.0::double) * 0.1::double) as score from metrics where uses >= 5)
        select prompt_type, arg_max(version_id, (score, -epoch_us(created_at))) as version_id, max(score) as score from scored group by prompt_type""",
}
