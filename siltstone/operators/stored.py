"""Stored tables: lookups, searches, joins between them, updates, saves, caches, archives, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import content_hash

STATUSES = ("pending", "processing", "completed", "failed", "cancelled")


def newest(df: DataFrame, by: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """O1: the rows that come last in `by`, by pages; `key` decides ties."""
    return df.orderBy(F.desc(by), key).offset(offset).limit(limit)


def lookup(df: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have the given values; `a__b` is the field b of a; None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name.replace("__", ".")) == F.lit(value))
    return df


def with_errors(processed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Some columns of the rows that have errors; null counts as none."""
    return processed.where(F.size(F.coalesce("processing_errors", F.array().cast("array<string>"))) > 0).select(*columns)


def quality_gate(content: DataFrame, least: float = 0.4, column: str = "content_quality_score") -> DataFrame:
    """P20: rows of `least` quality; nulls do not pass."""
    return content.where(F.col(column) >= least)


def by_domain(content: DataFrame, part: str) -> DataFrame:
    """P5: URLs with `part` in them, in any case."""
    return content.where(F.contains(F.lower("url"), F.lower(F.lit(part))))


def by_quality(content: DataFrame, least: float, most: float, column: str = "content_quality_score") -> DataFrame:
    """P5."""
    return content.where(F.col(column).between(least, most))


def tokens(*columns: str) -> Column:
    """Lower-cased words of letters and digits of some columns."""
    return F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")


def search(df: DataFrame, terms: Sequence[str], columns: Sequence[str], start: str | None = None, end: str | None = None, time: str = "timestamp", where: Column | None = None) -> DataFrame:
    """Rows with one of the terms among their words, and the other conditions."""
    out = df.where(F.arrays_overlap(tokens(*columns), F.array(*[F.lit(t.lower()) for t in terms])))
    if start is not None:
        out = out.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return out if where is None else out.where(where)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows, with the number of all, of pages, and whether there are more."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    n = total.first()["total"]
    pages = -(-n // size)
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumns({"total": F.lit(n), "total_pages": F.lit(pages), "has_next": F.lit(number < pages), "has_previous": F.lit(number > 1)})


def update(df: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows with the allowed columns of the last change for their key, where these are not null.

    The last change is that of the greatest `order`; of equal ones, and without an order, that of the greatest values.
    """
    new = [c for c in allowed if c in changes.columns]
    by = F.struct(*([order] if order else []), *new)
    last = changes.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*new), by).alias("__last"))
    named = last.select("__key", *[F.col("__last")[c].alias(f"__new_{c}") for c in new])
    out = df.join(named, df[key] == F.col("__key"), "left")
    for c in allowed:
        if c in changes.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"__new_{c}"), F.col(c)))
    return out.select(*df.columns)


def valid_status(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes with a known status, and the others with a reason."""
    good = F.col("status").isin(*STATUSES)
    return changes.where(good), changes.where(~F.coalesce(good, F.lit(False))).withColumn("reason", F.lit("invalid status"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds the names of the rules that a row breaks; a rule that is null is broken."""
    named = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])
    return df.withColumn("violations", F.filter(named, lambda x: x.isNotNull()))


def content_rules() -> dict[str, Column]:
    """P25: constraints of a row of content."""
    score = lambda c: F.col(c).isNull() | F.col(c).between(0.0, 1.0)
    return {
        "blank content": F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", "") != "",
        "content too large": F.col("content_size_bytes") <= 104_857_600,
        "quality out of range": score("content_quality_score"),
        "relevance out of range": score("relevance_score"),
        "negative time": F.col("processing_time") >= 0,
    }


#: Stages that a response reports, fixed values; the last one where results are stored.
STAGES = ("query_processing", "web_scraping", "ai_processing", "database_storage")


def response_rules(stored: bool = True) -> dict[str, Column]:
    """The contract of a response: query, results, analytics, execution_metadata and error (all may be null), status.

    query has text, category and confidence_score; results total_items, processed_items, success_rate and contents
    (array of url and content); analytics pages_scraped and processing_time_breakdown; execution_metadata
    execution_time_ms and stages_timing; error code, message and details (array of error_code and message).
    """
    there = lambda c: F.col(c).isNotNull()
    or_null = lambda c, rule: F.col(c).isNull() | rule
    least_0 = lambda c: or_null(c, F.col(c) >= 0)
    unit = lambda c: or_null(c, F.col(c).between(0.0, 1.0))
    times = lambda c: or_null(c, F.forall(F.map_values(c), lambda t: F.coalesce(t >= 0, F.lit(False))))
    timing = "execution_metadata.stages_timing"
    ok = F.col("status") == "success"
    unless = lambda when, rule: ~F.coalesce(when, F.lit(False)) | rule
    needed = {f"no {c}": unless(ok, F.col(c).isNotNull()) for c in (
        "query.text", "query.category", "query.confidence_score", "results.total_items", "results.processed_items", "results.success_rate", "analytics.pages_scraped", "analytics.processing_time_breakdown",
        "execution_metadata.execution_time_ms",
    )}
    stages = {f"no stage {x}": or_null(timing, F.map_contains_key(timing, F.lit(x))) for x in STAGES[: len(STAGES) - (not stored)]}
    return {
        "no status": there("status"), **needed, **stages, "empty category": or_null("query.category", F.col("query.category") != ""), "confidence out of range": unit("query.confidence_score"),
        "negative total": least_0("results.total_items"), "negative processed": least_0("results.processed_items"), "success rate out of range": unit("results.success_rate"),
        "content without url or text": or_null("results.contents", F.forall("results.contents", lambda x: x["url"].isNotNull() & x["content"].isNotNull())),
        "negative pages": least_0("analytics.pages_scraped"), "negative breakdown": times("analytics.processing_time_breakdown"), "negative execution time": least_0("execution_metadata.execution_time_ms"),
        "negative stage time": times(timing), "error without code or message": unless(~ok, there("error.code") & there("error.message")),
        "error detail incomplete": or_null("error.details", F.forall("error.details", lambda x: x["error_code"].isNotNull() & x["message"].isNotNull())),
    }


def response_violations(responses: DataFrame, key: str, stored: bool = True) -> DataFrame:
    """(key, violation): a row for each rule that a response breaks."""
    return violations(responses, response_rules(stored)).select(key, F.explode("violations").alias("violation"))


def size_guard(pages: DataFrame, limit: int = 10_485_760) -> tuple[DataFrame, DataFrame]:
    """Pages up to the limit, and an error row for each larger one."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    errors = pages.where(size > limit).select("page_id", "url", F.lit("content_too_large").alias("error_type"), size.cast("long").alias("size"), F.lit(False).alias("retryable"))
    return pages.where(size <= limit), errors


def save_content(new: DataFrame, stored: DataFrame, id_col: str = "_id") -> DataFrame:
    """New rows with content_hash and duplicate_of: the stored row, or the first new one, of the same text.

    Duplicates are stored too. The first of a hash is found by an aggregate, not by gathering its rows.
    """
    new = new.withColumn("content_hash", content_hash(F.coalesce("content", F.lit(""))))
    old = stored.groupBy("content_hash").agg(F.min(id_col).alias("__old"))
    first = new.groupBy("content_hash").agg(F.min(id_col).alias("__first"))
    out = new.join(first, "content_hash").join(old, "content_hash", "left")
    own = F.when(F.col(id_col) != F.col("__first"), F.col("__first"))
    return out.withColumn("duplicate_of", F.coalesce("__old", own)).drop("__old", "__first")


def latest_by_key(rows: DataFrame, key: str, time: str, as_of: str | None = None, expires: str = "expires_at") -> DataFrame:
    """The last row of each key, if it has not expired: by a bounded aggregate."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), time).alias("r")).select("r.*")
    return last if as_of is None else last.where(F.col(expires) > F.lit(as_of).cast("timestamp"))


def archived(live: DataFrame, archive: DataFrame, time: str, as_of: str, days: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(live, archive) after rows older than `days` have moved; a moved row replaces an archived one."""
    old = F.col(time) < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    moved = live.where(old)
    return live.where(~F.coalesce(old, F.lit(False))), moved.unionByName(archive.join(moved, key, "left_anti"))


def retained(df: DataFrame, time: str, as_of: str, days: int, also: Column | None = None) -> DataFrame:
    """Adds `deleted`: older than `days`, and the other condition holds."""
    old = F.col(time) < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return df.withColumn("deleted", F.coalesce(old if also is None else old & also, F.lit(False)))


def retention_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Deleted and kept rows of each table."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("table"), F.count_if("deleted").alias("deleted"), F.count_if(~F.col("deleted")).alias("kept"))
        out = row if out is None else out.unionByName(row)
    return out


def url_ids(content: DataFrame) -> DataFrame:
    """Url to id, its own or of what it duplicates; the last row of a url counts."""
    return content.groupBy("url").agg(F.max_by(F.coalesce("duplicate_of", "_id"), F.struct("timestamp", "_id")).alias("content_id"))


def resolved(processed: DataFrame, content: DataFrame, direct: str = "original_content_id", url: str = "original_url") -> DataFrame:
    """Adds content_id by direct id, else by url, and `unresolved`."""
    ids = content.select(F.col("_id").alias("__id")).distinct()
    byurl = url_ids(content).select(F.col("url").alias("__url"), F.col("content_id").alias("__by_url"))
    out = processed.join(ids, processed[direct] == F.col("__id"), "left").join(byurl, processed[url] == F.col("__url"), "left")
    return out.withColumn("content_id", F.coalesce("__id", "__by_url")).withColumn("unresolved", F.col("content_id").isNull()).drop("__id", "__url", "__by_url")


def query_results(queries: DataFrame, content: DataFrame, processed: DataFrame, sessions: DataFrame, most: int = 50) -> DataFrame:
    """Each query with its newest content and processed ids, their numbers, and its session."""

    def newest_of(df: DataFrame, key: str, time: str, name: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(time), key))
        top = df.withColumn("__p", place).where(F.col("__p") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("__p", F.col(key).alias("k")))).alias("l"))
        counts = df.groupBy("query_id").agg(F.count(F.lit(1)).alias(f"{name}_count"))
        return top.join(counts, "query_id").select(F.col("query_id").alias("__q"), F.array_join(F.transform("l", lambda x: x["k"].cast("string")), ",").alias(f"{name}_ids"), f"{name}_count")

    a, b = newest_of(content, "_id", "timestamp", "content"), newest_of(processed, "original_content_id", "processing_timestamp", "processed")
    s = sessions.select(F.col("session_id").alias("__s"), F.col("query_count").alias("session_queries"))
    out = queries.join(a, queries["_id"] == a["__q"], "left").drop("__q").join(b, queries["_id"] == b["__q"], "left").drop("__q")
    out = out.join(s, queries["session_id"] == F.col("__s"), "left").drop("__s")
    return out.fillna(0, ["content_count", "processed_count"])


def similar_content(analysis: DataFrame, content: DataFrame, one: int | str, least: float, limit: int = 10) -> DataFrame:
    """Of a row's duplicate groups the members that score `least` at least, best first."""
    rows = analysis.where(F.col("content_id") == one).select(F.explode(F.array_distinct(F.flatten("duplicate_groups"))).alias("member"), "similarity_scores")
    scored = rows.select("member", F.try_element_at("similarity_scores", F.col("member").cast("string")).alias("score")).where((F.col("member") != one) & (F.col("score") >= least))
    return scored.join(content, F.col("member") == F.col("_id")).orderBy(F.desc("score"), "member").limit(limit)


def cross_search(parts: dict[str, DataFrame]) -> DataFrame:
    """O2: results of several searches in one table, with their kind."""
    out = None
    for kind, df in parts.items():
        one = df.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
