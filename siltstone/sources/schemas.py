"""Schemas of the stored tables, and rows that conform to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = (
    "_id string, base_result struct<query_text:string,confidence_score:double,timestamp:timestamp,processing_time:double,category:string>, raw_entities string, suggestions array<string>, session_id string, user_id string, "
    "status string, execution_time double, result_count int, quality_score double, created_at timestamp, updated_at timestamp, version int"
)
CONTENT = (
    "_id string, url string, title string, content string, content_type string, author string, publish_date timestamp, description string, keywords array<string>, timestamp timestamp, processing_time double, "
    "content_size_bytes bigint, relevance_score double, content_quality_score double, extraction_method string, fallback_used boolean, query_id string, session_id string, content_hash string, duplicate_of string"
)
PROCESSED = (
    "original_content_id string, query_id string, session_id string, cleaned_content string, summary struct<executive_summary:string,key_points array<string>,confidence_score:double>, processing_timestamp timestamp, "
    "processing_duration double, enhanced_quality_score double, processing_errors array<string>, processing_version string, cache_key string, expires_at timestamp"
).replace("key_points array<string>", "key_points:array<string>")
SESSIONS = "session_id string, user_id string, start_time timestamp, end_time timestamp, duration_seconds double, query_count int, successful_queries int, failed_queries int, user_agent string, ip_address string, referrer string, status string"
LOAD_TEST = "scenario string, started timestamp, requests array<struct<duration_ms:double,status:int,cache:string,memory_mb:double>>"
SCHEMAS = {"queries": QUERIES, "content": CONTENT, "processed_content": PROCESSED, "query_sessions": SESSIONS}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table in its types; missing ones are null, others go; values that do not fit are null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name).fields])
