"""Writing tables and reports, and reading load-test results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.schemas import LOAD_TEST, conform


def append(df: DataFrame, name: str, path: str, day: str | None = None) -> None:
    """Appends conforming rows; by the day of a time column, if one is given."""
    out = conform(df, name)
    if day is None:
        out.write.mode("append").parquet(path)
    else:
        out.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def load_tests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Requests out of JSON documents of load tests, one a file or one a line, in rows."""
    runs = spark.read.schema(LOAD_TEST).option("multiLine", not lines).json(path)
    return runs.select("scenario", "started", F.posexplode("requests").alias("request", "r")).select("scenario", "started", "request", "r.*")


def export_json(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)
