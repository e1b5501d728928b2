"""Statistics of the stored tables: queries, content, processing, sessions, periods.

Sums of nothing are 0, averages skip nulls and are 0.0 on an empty table only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.tables import written

#: Sessions are of high quality from the first on, of medium quality from the second on.
HIGH, MEDIUM = 0.7, 0.4


def avg0(c: str) -> Column:
    """The average; 0.0 where there is no row at all."""
    return F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(F.avg(c))


def sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def within(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("timestamp"))


def query_statistics(queries: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A1: one row over an optional range of created_at."""
    return within(queries, "created_at", start, end).agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if(F.col("status") == "completed").alias("completed_queries"), F.count_if(F.col("status") == "failed").alias("failed_queries"),
        avg0("execution_time").alias("average_execution_time"), F.coalesce(F.sum("execution_time"), F.lit(0.0)).alias("total_execution_time"), avg0("quality_score").alias("average_quality_score"),
    )


def popular_queries(queries: DataFrame, as_of: str, days: int = 7, limit: int = 10) -> DataFrame:
    """A2: query texts of the last days, most frequent first."""
    recent = queries.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    out = recent.groupBy("query_text").agg(F.count(F.lit(1)).alias("count"), F.avg("quality_score").alias("avg_quality"), F.avg("execution_time").alias("avg_execution_time"), F.max("created_at").alias("last_executed"))
    return out.orderBy(F.desc("count"), "query_text").limit(limit)


def content_stats(content: DataFrame) -> DataFrame:
    """A3: one row; a domain is a scheme and host as written, http and https apart."""
    domain = F.regexp_extract("url", "https?://([^/]+)", 0)
    return content.agg(
        F.count(F.lit(1)).alias("total_content"), sum0("content_size_bytes").cast("long").alias("total_size_bytes"), avg0("processing_time").alias("average_processing_time"),
        avg0("content_quality_score").alias("average_quality_score"), avg0("relevance_score").alias("average_relevance_score"),
        F.count_distinct(F.nullif(domain, F.lit(""))).alias("unique_domains"), F.array_join(F.sort_array(F.collect_set("content_type")), ",").alias("content_types"),
    )


def duplicate_groups(content: DataFrame, limit: int = 20) -> DataFrame:
    """A4: rows with duplicate_of, by original: how many, the least and greatest id, the first time. Members: duplicate_members."""
    dup = content.where(F.col("duplicate_of").isNotNull())
    top = dup.groupBy("duplicate_of").agg(F.count(F.lit(1)).alias("duplicate_count"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"), F.min("timestamp").alias("first_seen"))
    return top.orderBy(F.desc("duplicate_count"), "duplicate_of").limit(limit)


def duplicate_members(content: DataFrame, limit: int = 20) -> DataFrame:
    """A4: the groups of duplicate_groups with all of their members, one row each, so that no group is gathered."""
    top = written(duplicate_groups(content, limit), "top")
    members = content.select("duplicate_of", F.col("_id").alias("member"), "url", "title", "timestamp")
    return members.join(F.broadcast(top), "duplicate_of")


def processing_analytics(processed: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A5: one row; errors are the sizes of the error arrays."""
    return within(processed, "processing_timestamp", start, end).agg(
        F.count(F.lit(1)).alias("total_processed"), avg0("processing_duration").alias("average_duration"), F.coalesce(F.sum("processing_duration"), F.lit(0.0)).alias("total_duration"),
        avg0("enhanced_quality_score").alias("average_quality_score"), F.coalesce(F.sum(F.size("processing_errors")), F.lit(0)).cast("long").alias("total_errors"),
        F.array_join(F.sort_array(F.collect_set("processing_version")), ",").alias("versions"),
    )


def quality_distribution(processed: DataFrame) -> DataFrame:
    """Low under 0.3 and null, medium under 0.7, high."""
    q = F.col("enhanced_quality_score")
    band = F.when(q.isNull() | (q < 0.3), "low").when(q < 0.7, "medium").otherwise("high")
    return processed.groupBy(band.alias("quality_band")).agg(F.count(F.lit(1)).alias("count"))


def usage_statistics(sessions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row over sessions; users are exact."""
    return within(sessions, "start_time", start, end).agg(
        F.count(F.lit(1)).alias("total_sessions"), F.count_distinct("user_id").alias("unique_users"), sum0("query_count").cast("long").alias("total_queries"),
        sum0("successful_queries").cast("long").alias("successful_queries"), sum0("failed_queries").cast("long").alias("failed_queries"),
        F.coalesce(F.sum("total_processing_time"), F.lit(0.0)).alias("total_processing_time"), avg0("average_quality_score").alias("average_quality_score"),
    )


def popular_sessions(sessions: DataFrame, as_of: str, days: int = 7, limit: int = 10) -> DataFrame:
    """Sessions of the last days with most queries."""
    recent = sessions.where(F.col("start_time") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    out = recent.groupBy("session_id").agg(F.sum("query_count").alias("total_queries"), F.avg("average_quality_score").alias("avg_quality"), F.sum("total_processing_time").alias("total_time"))
    return out.orderBy(F.desc("total_queries"), "session_id").limit(limit)


def session_quality(sessions: DataFrame) -> DataFrame:
    """Sessions by quality: high from 0.7, medium from 0.4, else low, nulls too."""
    q = F.col("average_quality_score")
    return sessions.agg(
        F.count_if(q >= HIGH).alias("high_quality"), F.count_if((q >= MEDIUM) & (q < HIGH)).alias("medium_quality"), F.count_if(q.isNull() | (q < MEDIUM)).alias("low_quality"),
        avg0("average_quality_score").alias("average_quality"), F.count(F.lit(1)).alias("total_sessions"),
    )


def averages_in_order(sessions: DataFrame, queries: DataFrame) -> DataFrame:
    """(session_id, average_quality_score) of `sessions`; where the order of addition can decide on A9, that of the ids counts.

    Sums of doubles depend on that order in their last bits, and partial sums are added as splits come. Averages of n scores
    from 0 to 1 differ by less than n * 1e-15 between orders, so only sessions that near to a bound are added anew.
    """
    near = lambda bound: F.abs(F.col("average_quality_score") - bound) <= F.col("query_count") * 1e-15
    found = written(sessions.select("session_id", "average_quality_score", F.coalesce(near(HIGH) | near(MEDIUM), F.lit(False)).alias("open")), "sessions")
    few = found.where("open").select(F.col("session_id").alias("__s"))
    rows = queries.join(few, F.col("session_id").eqNullSafe(F.col("__s")), "left_semi")
    w = W.partitionBy("session_id").orderBy("_id", "created_at", "quality_score")
    sums = rows.select("session_id", F.avg("quality_score").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("average_quality_score"), F.lead(F.lit(True)).over(w).isNull().alias("last"))
    return found.where("not open").drop("open").unionByName(sums.where("last").drop("last"))


def period_rollup(queries: DataFrame, unit: str) -> DataFrame:
    """A10: counters by hour, day, week or month of created_at; users and sessions are exact in each period."""
    start = F.date_trunc(unit, "created_at")
    return queries.groupBy(start.alias("period_start")).agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if(F.col("status") == "completed").alias("successful_queries"), F.count_if(F.col("status") == "failed").alias("failed_queries"),
        F.count_distinct("user_id").alias("unique_users"), F.count_distinct("session_id").alias("unique_sessions"), F.avg("quality_score").alias("average_quality_score"),
    )


def distinct_sketches(queries: DataFrame, unit: str = "hour", lg: int = 14) -> DataFrame:
    """A10, A11 at scale: by period a sketch of the different users and one of the sessions, to be stored and merged.

    A sketch takes 2**lg bytes at most and errs by about 1.04 / sqrt(2**lg), 0.8 percent as given: 5 percent are six times
    that, so that none of many periods misses them. Nulls are not counted.
    """
    return queries.groupBy(F.date_trunc(unit, "created_at").alias("period_start")).agg(F.hll_sketch_agg("user_id", F.lit(lg)).alias("users"), F.hll_sketch_agg("session_id", F.lit(lg)).alias("sessions"))


def merged_distinct(sketches: DataFrame, unit: str) -> DataFrame:
    """Different users and sessions of longer periods, estimated from the sketches of shorter ones, without their rows."""
    merged = sketches.groupBy(F.date_trunc(unit, "period_start").alias("period_start")).agg(F.hll_union_agg("users").alias("u"), F.hll_union_agg("sessions").alias("s"))
    return merged.select("period_start", F.hll_sketch_estimate("u").alias("users_estimate"), F.hll_sketch_estimate("s").alias("sessions_estimate"))


def daily_report(hourly: DataFrame, sessions: DataFrame) -> DataFrame:
    """Hourly counters summed by day; users counted anew from the sessions that began on the day."""
    sums = hourly.groupBy(F.to_date("period_start").alias("day")).agg(F.sum("total_queries").alias("total_queries"), F.sum("failed_queries").alias("failed_queries"))
    users = sessions.groupBy(F.to_date("start_time").alias("day")).agg(F.count_distinct("user_id").alias("unique_users"), F.count(F.lit(1)).alias("sessions"))
    return sums.join(users, "day", "left")


def weekly_report(daily: DataFrame) -> DataFrame:
    """Daily rows by week, with the set of the daily user counts."""
    return daily.groupBy(F.date_trunc("week", "period_start").alias("week")).agg(
        F.sum("total_queries").alias("total_queries"), F.avg("average_quality_score").alias("average_quality"), F.array_join(F.sort_array(F.collect_set("unique_users")), ",").alias("daily_users"),
    )


def category_breakdown(queries: DataFrame, unit: str) -> DataFrame:
    """Queries by period and category, in rows: what period reports merge."""
    return queries.groupBy(F.date_trunc(unit, "created_at").alias("period_start"), "category").agg(F.count(F.lit(1)).alias("n"))


def monthly_report(daily: DataFrame, breakdown: DataFrame, weekly: DataFrame | None = None) -> DataFrame:
    """Daily rows by month, and of each category the count of the last day that has it.

    With `weekly` rows these are added to the sums as well, as the older reports did.
    """
    rows = daily if weekly is None else daily.unionByName(weekly)
    month = F.date_trunc("month", "period_start").alias("month")
    sums = rows.groupBy(month).agg(F.sum("total_queries").alias("total_queries"), F.avg("average_quality_score").alias("average_quality"), F.count(F.lit(1)).alias("periods"))
    last = breakdown.groupBy(month, "category").agg(F.max_by("n", "period_start").alias("n"))
    merged = last.groupBy("month").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "category", "n"))), ",").alias("category_breakdown"))
    return sums.join(merged, "month", "left")


def report(kind: str, queries: DataFrame, sessions: DataFrame) -> DataFrame:
    """The daily, weekly or monthly report."""
    if kind == "daily":
        return daily_report(period_rollup(queries, "hour"), sessions)
    daily = period_rollup(queries, "day")
    if kind == "weekly":
        return weekly_report(daily)
    if kind == "monthly":
        return monthly_report(daily, category_breakdown(queries, "day"))
    raise ValueError(f"no report {kind!r}: daily, weekly or monthly")


def close_sessions(sessions: DataFrame) -> DataFrame:
    """Duration and average query time; null where there is no query."""
    seconds = (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6)
    return sessions.select("session_id", seconds.alias("duration_seconds"), F.when(F.col("query_count") > 0, F.col("total_processing_time") / F.col("query_count")).alias("average_query_time"), F.lit("completed").alias("status"))


def table_profile(tables: dict[str, DataFrame], required: list[str], sizes: dict[str, str]) -> DataFrame:
    """Rows, average of a size column and health of each required table; a table that is missing is unhealthy."""
    out = None
    for name in required:
        if (df := tables.get(name)) is None:
            row = None
        else:
            row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.avg(sizes[name]).cast("double").alias("average_size") if name in sizes else F.lit(None).cast("double").alias("average_size"))
        if row is None:
            spark = next(iter(tables.values())).sparkSession
            row = spark.range(1).select(F.lit(name).alias("table"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("double").alias("average_size"))
        out = row if out is None else out.unionByName(row)
    status = F.when(F.col("rows").isNull(), "unhealthy").when(F.col("rows") == 0, "degraded").otherwise("healthy")
    return out.withColumns({"status": status, "has_sample": F.coalesce(F.col("rows") > 0, F.lit(False))})


def overall_health(parts: DataFrame, status: str = "status") -> DataFrame:
    """The worst of all statuses, healthy < degraded < unhealthy, with how many parts have each; unknown ones are unhealthy."""
    level = F.when(F.col(status) == "healthy", 0).when(F.col(status) == "degraded", 1).otherwise(2)
    worst = F.element_at(F.array(*map(F.lit, ("healthy", "degraded", "unhealthy"))), F.coalesce(F.max(level), F.lit(0)) + 1)
    return parts.agg(worst.alias("status"), *[F.count_if(level == i).alias(name) for i, name in enumerate(("healthy", "degraded", "unhealthy"))])
