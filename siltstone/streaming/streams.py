"""Structured Streaming forms of the log operators.

Batch results are kept where the stream allows: counts by hour and endpoint are equal to the batch ones once the
watermark has passed. Those that take the rows of a key in the order of time are in `ordered`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import content_hash
from siltstone.operators.logs import BUCKETS
from siltstone.operators.stored import save_content
from siltstone.streaming.ordered import cached_results, idle_sessions, rate_limited, session_states  # noqa: F401

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table_stream(spark: SparkSession, folder: str, schema: str, names: str, files: int | None = 1) -> DataFrame:
    """Rows of the parquet tables of a folder with such names, as they arrive.

    A table is a file, or a folder of part files: files are watched in `folder` itself, part files in each folder that
    is there when the stream starts. With `files` of None all that is there makes one micro-batch.
    """
    at_once = {"maxFilesPerTrigger": files} if files else {}
    source = lambda path, only: spark.readStream.schema(schema).options(pathGlobFilter=only, **at_once).parquet(path)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{names}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    rows = source(folder, names)
    for f in sorted(f.getPath().toString() for f in found if f.isDirectory()):
        rows = rows.unionByName(source(f, "*"))
    return rows


def event_stream(spark: SparkSession, folder: str, files: int | None = 1, names: str = "events*.parquet") -> DataFrame:
    """Events as they arrive; ts is event time."""
    return table_stream(spark, folder, EVENTS, names, files).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """ST1: events by hour, with about how many users; rows later than `late` are left out."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"))
    return out.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("value"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("period_start"), "events", "errors", "value", "users")


def endpoint_metrics(events: DataFrame) -> DataFrame:
    """ST5: running counts, times and cumulative buckets by type; for update or complete mode."""
    seconds = F.col("value") / F.lit(10.0)
    buckets = [F.count_if(seconds <= b).alias(f"le_{i}") for i, b in enumerate(BUCKETS)]
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.sum(seconds).alias("seconds"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), *buckets)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """ST4: sessions of a user, closed by a gap."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return out.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "events", "value")


def first_of_content(content: DataFrame, late: str = "1 day") -> DataFrame:
    """ST3: content rows whose text was not seen within the watermark."""
    return content.withColumn("content_hash", content_hash(F.coalesce("content", F.lit("")))).withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["content_hash"])


def save_batches(content: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """ST3, exact: each micro-batch is joined with what is stored, and appended with its duplicates named.

    A batch that is run again after a failure finds its own rows stored: these are left out by id.
    """

    def save(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        stored = spark.read.parquet(path) if there else spark.createDataFrame([], "_id bigint, content_hash string")
        save_content(batch.join(stored.select("_id"), "_id", "left_anti"), stored.select("_id", "content_hash")).write.mode("append").parquet(path)

    return content.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
