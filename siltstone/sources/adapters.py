"""The driver's tables as the tables that the operators work on, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import table

CATEGORIES = ("ai_tools", "mutual_funds", "general")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _of_three(x: Column, values: tuple[str, ...]) -> Column:
    return F.when(x % 3 == 0, values[0]).when(x % 3 == 1, values[1]).otherwise(values[2])


def queries_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per query: from events."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("_id"), "user_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("session_id"),
        F.concat("event_type", F.lit(" "), F.col("k").cast("string")).alias("query_text"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("purchase", "signup"), "completed").otherwise("processing").alias("status"),
        F.col("value").cast("double").alias("execution_time"),
        F.when(F.col("k") % 10 == 0, F.lit(None).cast("double")).otherwise((F.col("k") % 101).cast("double") / F.lit(100.0)).alias("quality_score"),
        ts.alias("created_at"), _of_three(F.col("k"), CATEGORIES).alias("category"),
    )


QUERIES_SQL = """queries_t as (
  select event_id as _id, user_id, cast(user_id as varchar) || '-' || cast(cast(ts as date) as varchar) as session_id,
    event_type || ' ' || cast(k as varchar) as query_text,
    case when event_type = 'error' then 'failed' when event_type in ('purchase', 'signup') then 'completed' else 'processing' end as status,
    cast(value as double) as execution_time, case when k % 10 = 0 then null else cast(k % 101 as double) / 100.0::double end as quality_score,
    ts as created_at, case k % 3 when 0 then 'ai_tools' when 1 then 'mutual_funds' else 'general' end as category
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))"""


def sessions_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session: counters over its queries."""
    return session_counters(queries_t(spark, sf_dir))


def session_counters(queries: DataFrame) -> DataFrame:
    """Sessions from the log of their queries: who, when, how many, how long, how good."""
    return queries.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"), F.min("created_at").alias("start_time"), F.max("created_at").alias("end_time"), F.count(F.lit(1)).alias("query_count"),
        F.count_if(F.col("status") == "completed").alias("successful_queries"), F.count_if(F.col("status") == "failed").alias("failed_queries"),
        F.sum("execution_time").alias("total_processing_time"), F.avg("quality_score").alias("average_quality_score"),
    )


SESSIONS_SQL = (
    QUERIES_SQL
    + """, sessions_t as (
  select session_id, min(user_id) as user_id, min(created_at) as start_time, max(created_at) as end_time, count(*) as query_count,
    count(*) filter (status = 'completed') as successful_queries, count(*) filter (status = 'failed') as failed_queries,
    sum(execution_time) as total_processing_time, avg(quality_score) as average_quality_score
  from queries_t group by session_id)"""
)


def requests_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log: from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("user_id").alias("client"), F.col("event_type").alias("path"), F.col("event_type").alias("scenario"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("value").cast("double") * F.lit(100.0)).alias("duration_ms"),
        F.when(_k() % 2 == 0, "HIT").otherwise("MISS").alias("cache"),
    )


REQUESTS_SQL = """requests_t as (
  select ts, event_id, user_id as client, event_type as path, event_type as scenario, case when event_type = 'error' then 500 else 200 end as status,
    cast(value as double) * 100.0::double as duration_ms, case when cast(json_extract_string(props, '$.k') as int) % 2 = 0 then 'HIT' else 'MISS' end as cache from events)"""

TYPES = ("article", "documentation", "general")


def content_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped content: documents with their labels."""
    d = table(spark, sf_dir, "documents")
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    start = F.lit("2024-01-01").cast("timestamp")
    return d.join(quality, "doc_id", "left").select(
        F.col("doc_id").alias("_id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), _of_three(F.col("doc_id"), TYPES).alias("content_type"),
        F.octet_length("text").cast("long").alias("content_size_bytes"), (F.col("n_chars").cast("double") / F.lit(1000.0)).alias("processing_time"),
        (F.lit(0.4) + F.lit(0.5) * F.col("quality").cast("double")).alias("content_quality_score"), ((F.col("doc_id") % 100).cast("double") / F.lit(100.0)).alias("relevance_score"),
        F.timestamp_seconds(F.unix_timestamp(start) + F.col("doc_id") * 60).alias("timestamp"), (F.col("doc_id") % 25).alias("query_id"),
    )


def texts_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped content without what labels say of it, so that texts need no join."""
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), url.alias("url"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"))


CONTENT_SQL = """content_t as (
  select d.doc_id as _id, 'https://' || source || '.example.org/' || lang || '/' || cast(d.doc_id as varchar) as url, cast(null as varchar) as title, text as content,
    case d.doc_id % 3 when 0 then 'article' when 1 then 'documentation' else 'general' end as content_type, octet_length(encode(text)) as content_size_bytes,
    cast(n_chars as double) / 1000.0::double as processing_time, 0.4::double + 0.5::double * cast(l.quality as double) as content_quality_score,
    cast(d.doc_id % 100 as double) / 100.0::double as relevance_score, timestamp '2024-01-01' + to_minutes(d.doc_id) as timestamp, d.doc_id % 25 as query_id
  from documents d left join labels l on d.doc_id = l.doc_id)"""


def processed_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed content: one row for each row of content."""
    c = content_t(spark, sf_dir)
    errors = F.when(F.col("_id") % 17 == 0, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>"))
    return c.select(
        F.col("_id").alias("original_content_id"), "query_id", F.col("content_quality_score").alias("enhanced_quality_score"), F.col("processing_time").alias("processing_duration"),
        (F.col("timestamp") + F.expr("interval 1 minute")).alias("processing_timestamp"), errors.alias("processing_errors"), F.lit("1.0").alias("processing_version"),
    )


PROCESSED_SQL = (
    CONTENT_SQL
    + """, processed_t as (
  select _id as original_content_id, query_id, content_quality_score as enhanced_quality_score, processing_time as processing_duration,
    timestamp + interval 1 minute as processing_timestamp, case when _id % 17 = 0 then ['timeout'] else [] end as processing_errors, '1.0' as processing_version from content_t)"""
)


def user_queries_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users asked: from conversations."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("raw_query"))


USER_QUERIES_SQL = "user_queries_t as (select conv_id, turn, text as raw_query from conversations where role = 'user')"
