"""Request logs: endpoint metrics, histograms, percentiles, load tests, limits, schedules, regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.operators.prefix import global_totals, in_ranges, inside, parts_before, with_parts
from siltstone.sources.tables import written

#: Upper bounds of a duration histogram in seconds, fixed values of the metrics format.
BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def endpoint_metrics(requests: DataFrame, slow_ms: float = 5000.0) -> DataFrame:
    """Requests by path."""
    d, s = F.col("duration_ms"), F.col("status")
    return requests.groupBy("path").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(d).alias("total_ms"), F.avg(d).alias("average_ms"), F.min(d).alias("least_ms"), F.max(d).alias("most_ms"),
        F.count_if(s >= 400).alias("errors"), F.count_if((s >= 400) & (s < 500)).alias("client_errors"), F.count_if(s >= 500).alias("server_errors"),
        F.count_if(F.col("cache") == "HIT").alias("cache_hits"), F.count_if(F.col("cache") == "MISS").alias("cache_misses"), F.count_if(d > slow_ms).alias("slow"),
    )


def histogram(requests: DataFrame, buckets: Sequence[float] = BUCKETS) -> DataFrame:
    """Cumulative counts of durations in seconds, a row for each path and bound; +Inf is null."""
    value = F.col("duration_ms") / F.lit(1000.0)
    counts = [F.count_if(value <= b).alias(f"c{i}") for i, b in enumerate(buckets)]
    wide = requests.groupBy("path").agg(*counts, F.count(F.lit(1)).alias("n"), F.sum(value).alias("total_seconds"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"c{i}").alias("count")) for i, b in enumerate(buckets)], F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("count")))
    return wide.select("path", "total_seconds", F.inline(rows))


def counters(requests: DataFrame, by: str, amount: Column, resets: DataFrame) -> DataFrame:
    """Counters by name: the sum of what came since the last reset; `resets` (by, ts) may lack names.

    `resets` is joined by name; its last row of a name counts.
    """
    last = resets.groupBy(F.col(by).alias("__by")).agg(F.max("ts").alias("__reset"))
    since = requests.join(last, F.col(by) == F.col("__by"), "left")
    counted = F.when(F.col("__reset").isNull() | (F.col("ts") >= F.col("__reset")), amount).otherwise(0)
    return since.groupBy(by).agg(F.sum(counted).alias("value"), F.max("__reset").alias("reset_at"))


def gauges(samples: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """Gauges by name: the value that was set last."""
    return samples.groupBy(by).agg(F.max_by(value, F.struct("ts", key)).alias("value"), F.max("ts").alias("set_at"))


def ranked_values(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, v, c, before, n): each different value of a group, its rows, the rows below it, and the group's.

    Counts come first and are then totalled by ranges of (group, value), so that a group of any size is no task's own.
    """
    counts = in_ranges(df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")), group, ["v"])
    parts = counts.groupBy(group, "__p").agg(F.sum("c").alias("__s"))
    parts = parts.select(group, "__p", F.coalesce(F.sum("__s").over(parts_before(group)), F.lit(0)).alias("__o"), F.sum("__s").over(W.partitionBy(group)).alias("n"))
    own = F.coalesce(F.sum("c").over(inside(group, ["v"]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return with_parts(counts.withColumn("__r", own), parts, group).select(group, "v", "c", (F.col("__o") + F.col("__r")).alias("before"), "n")


def percentiles_nearest(df: DataFrame, group: str, value: str, ps: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """The value at place min(int(n * p / 100), n - 1) of the sorted ones, by ranks, without gathering a group."""
    at = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    here = lambda p: (F.col("before") <= at(p)) & (at(p) < F.col("before") + F.col("c"))
    return ranked_values(df, group, value).groupBy(group).agg(*[F.max(F.when(here(p), F.col("v"))).alias(f"p{p}") for p in ps], F.max("n").alias("n"))


def percentiles_linear(df: DataFrame, group: str, value: str, ps: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """Interpolated at (n - 1) p / 100, by ranks, without gathering a group. Groups without a value are absent."""
    place = lambda p: (F.col("n") - 1) * p / F.lit(100.0)
    here = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("c"))
    ends = [F.max(F.when(here(end(place(p))), F.col("v"))).alias(f"{k}{p}") for p in ps for k, end in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked_values(df, group, value).groupBy(group).agg(*ends, F.max("n").alias("n"))
    between = lambda p: F.col(f"lo{p}") + (F.col(f"hi{p}") - F.col(f"lo{p}")) * (place(p) - F.floor(place(p)))
    return found.select(group, *[between(p).alias(f"p{p}") for p in ps], "n")


def load_summary(requests: DataFrame) -> DataFrame:
    """By scenario: success rate, durations, cache hits and throttled requests in percent."""
    n, d = F.count(F.lit(1)), F.col("duration_ms")
    percent = lambda c: F.lit(100.0) * F.count_if(c) / n
    out = requests.groupBy("scenario").agg(
        n.alias("requests"), percent(F.col("status") < 400).alias("success_rate"), F.min(d).alias("least_ms"), F.max(d).alias("most_ms"), F.avg(d).alias("average_ms"),
        percent(F.col("cache") == "HIT").alias("cache_hit_rate"), percent(F.col("status") == 429).alias("throttled_rate"),
    )
    return out.join(percentiles_linear(requests, "scenario", "duration_ms", (50, 95)).drop("n"), "scenario", "left")


def cache_efficiency(requests: DataFrame) -> DataFrame:
    """Hits and misses by scenario, speed-up, and flags: under half are hits; a hit takes over 0.8 of a miss."""
    hit = F.col("cache") == "HIT"
    out = requests.groupBy("scenario").agg(
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.avg(F.when(hit, F.col("duration_ms"))).alias("hit_ms"), F.avg(F.when(~hit, F.col("duration_ms"))).alias("miss_ms"),
    )
    rate = F.lit(100.0) * F.col("hits") / (F.col("hits") + F.col("misses"))
    return out.withColumns({"hit_rate": rate, "speed_up": F.try_divide("miss_ms", "hit_ms"), "low_hit_rate": rate < 50, "slow_hits": F.col("hit_ms") > F.lit(0.8) * F.col("miss_ms")})


def rate_limit_behaviour(flagged: DataFrame, limit: int) -> DataFrame:
    """Of requests with `blocked` and `in_window`: sent, blocked, block rate, and those over the limit that passed.

    With `remaining`, what an answer's header says is left, answers whose header is absent or wrong are counted too.
    """
    n = F.count(F.lit(1))
    out = [n.alias("sent"), F.count_if("blocked").alias("blocked"), (F.lit(100.0) * F.count_if("blocked") / n).alias("block_rate"), F.count_if((F.col("in_window") > limit) & ~F.col("blocked")).alias("passed_over_limit")]
    if "remaining" in flagged.columns:
        right = F.col("remaining") == F.greatest(F.lit(0), F.lit(limit) - F.col("in_window"))
        out.append(F.count_if(~F.coalesce(right, F.lit(False))).alias("header_failures"))
    return flagged.groupBy("client").agg(*out)


def memory_growth(samples: DataFrame, by: str, ts: str, mb: str, leak_mb: float = 10.0, per: int = 100, peak_mb: float = 1000.0) -> DataFrame:
    """Start, end, peak, least and mean memory; a leak when it grows by over `leak_mb` in `per` requests."""
    order = F.struct(ts, mb)
    out = samples.groupBy(by).agg(
        F.min_by(mb, order).alias("start_mb"), F.max_by(mb, order).alias("end_mb"), F.max(mb).alias("peak_mb"), F.min(mb).alias("least_mb"), F.avg(mb).alias("average_mb"), F.count(F.lit(1)).alias("samples"),
    )
    growth = (F.col("end_mb") - F.col("start_mb")) / F.col("samples")
    return out.withColumns({"growth_per_request": growth, "leak": growth * per > leak_mb, "high_peak": F.col("peak_mb") > peak_mb})


def pool_utilisation(samples: DataFrame, by: str, used: str, size: str, full: float = 80.0) -> DataFrame:
    """Connections in use in percent; saturated over `full`."""
    share = F.lit(100.0) * F.col(used) / F.col(size)
    return samples.groupBy(by).agg(F.avg(share).alias("average_percent"), F.max(share).alias("most_percent"), F.count_if(share > full).alias("saturated_samples")).withColumn("saturated", F.col("most_percent") > full)


def stage_report(timings: DataFrame, stage: str, value: str, limits: dict[str, float], default_limit: float) -> DataFrame:
    """By stage: spread, percentiles, outliers over p95, advice and status against the stage's limit."""
    stats = timings.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    stats = written(stats.join(percentiles_linear(timings, stage, value, (50, 95)).drop("n").withColumnRenamed("p50", "median"), stage, "left"), "stages")
    over = timings.join(stats.select(stage, "p95"), stage).where(F.col(value) > F.col("p95")).groupBy(stage).agg(F.count(F.lit(1)).alias("outliers"))
    out = stats.join(over, stage, "left").withColumns({"outliers": F.coalesce("outliers", F.lit(0)), "limit": _limit_of(F.col(stage), limits, default_limit)})
    return out.withColumns({"mean_near_limit": F.col("mean") > F.lit(0.8) * F.col("limit"), "most_over_limit": F.col("most") > F.col("limit"), "status": stage_status(F.col("mean"), F.col("limit"))})


def _limit_of(stage: Column, limits: dict[str, float], default_limit: float) -> Column:
    limit = F.lit(float(default_limit))
    for name, x in limits.items():
        limit = F.when(stage == name, float(x)).otherwise(limit)
    return limit


def stage_status(value: Column, limit: Column) -> Column:
    """By the share of the limit; unknown where that is 0."""
    share = F.try_divide(value, limit)
    return F.when(limit == 0, "UNKNOWN").when(share < 0.5, "EXCELLENT").when(share < 0.8, "GOOD").when(share < 1.0, "ACCEPTABLE").when(share < 1.2, "SLOW").otherwise("CRITICAL")


def overall_status(timings: DataFrame, request: str, stage: str, value: str, limits: dict[str, float], default_limit: float, total_limit: float) -> DataFrame:
    """By request: the time of its stages, the status of that, its slow and critical stages, and PASS, WARN or FAIL.

    A critical stage fails, else a slow one warns; else the total decides: critical fails, slow or acceptable warns.
    """
    status = stage_status(F.col(value), _limit_of(F.col(stage), limits, default_limit))
    out = timings.withColumn("__status", status).groupBy(request).agg(F.sum(value).alias("total"), F.count_if(F.col("__status") == "SLOW").alias("slow"), F.count_if(F.col("__status") == "CRITICAL").alias("critical"))
    out = out.withColumn("total_status", stage_status(F.col("total"), F.lit(float(total_limit))))
    by_total = F.when(F.col("total_status") == "CRITICAL", "FAIL").when(F.col("total_status").isin("SLOW", "ACCEPTABLE"), "WARN").otherwise("PASS")
    return out.withColumn("overall", F.when(F.col("critical") > 0, "FAIL").when(F.col("slow") > 0, "WARN").otherwise(by_total))


def stage_shares(timings: DataFrame, request: str, value: str) -> DataFrame:
    """Each stage's part of its request's time, in percent. Rows without a request have no total, and 0."""
    totals = timings.groupBy(F.col(request).alias("__request")).agg(F.sum(value).alias("__total"))
    share = F.when(F.col("__total") > 0, F.lit(100.0) * F.col(value) / F.col("__total")).otherwise(0.0)
    return timings.join(totals, F.col(request) == F.col("__request"), "left").withColumn("percent_of_total", share).drop("__request", "__total")


def response_metrics(items: DataFrame, request: str, ok: Column, ts: str) -> DataFrame:
    """By request: its items, those that are ok, their share, milliseconds from first to last, and items a second.

    A condition that is null is not ok. Without any time in between, throughput is 0. `stage_shares` has the stages' parts.
    """
    n, good = F.count(F.lit(1)), F.count_if(F.coalesce(ok, F.lit(False)))
    out = items.groupBy(request).agg(n.alias("items_processed"), good.alias("items_successful"), (good / n).alias("success_rate"), ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1000.0)).alias("execution_ms"))
    return out.withColumn("items_per_second", F.when(F.col("execution_ms") > 0, F.col("items_processed") / (F.col("execution_ms") / 1000)).otherwise(0.0))


def success_summary(requests: DataFrame) -> DataFrame:
    """Ok, failed and the rate, of all."""
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("status") < 400)
    return requests.agg(n.alias("total"), ok.alias("successful"), (n - ok).alias("failed"), F.when(n > 0, F.bround(ok / n, 3)).otherwise(0.0).alias("success_rate"))


def error_patterns(requests: DataFrame, kind: str = "path", site: str = "client", key: str = "event_id", message: str | None = None, examples: int = 3) -> DataFrame:
    """Errors by their type: how many, on how many sites, the first examples, and the success rate of all requests.

    Examples are the messages, or keys, of the errors that come first by key: found by rank, so that no type's errors
    are gathered.
    """
    errors = requests.where(F.col("status") >= 400)
    first = errors.withColumn("rank", F.row_number().over(W.partitionBy(kind).orderBy(key))).where(F.col("rank") <= examples)
    said = F.col(message or key).cast("string").alias("said")
    named = first.groupBy(F.col(kind).alias("__kind")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", said))), lambda x: x["said"]), ",").alias("examples"))
    overall = requests.agg(F.try_divide(F.count_if(F.col("status") < 400), F.count(F.lit(1))).alias("overall_success_rate"))
    out = errors.groupBy(kind).agg(F.count(F.lit(1)).alias("errors"), F.count_distinct(site).alias("sites"))
    # one row of one number meets every type over a constant key
    out = out.join(named, F.col(kind).eqNullSafe(F.col("__kind"))).drop("__kind").withColumn("__one", F.lit(1))
    return out.join(F.broadcast(overall.withColumn("__one", F.lit(1))), "__one").drop("__one")


def window_counts(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the client in (t - seconds, t], this one included, in order of arrival.

    That is the request's place less the number of the client's requests up to t - seconds. Both are running counts in
    one order of requests and of the ends of their windows, which are totalled by ranges, whatever share a client has.
    """
    rows = written(requests.withColumn("__row", F.monotonically_increasing_id()), "requests")
    micros = F.unix_micros("ts")
    here = rows.select("client", micros.alias("at"), F.lit(0).alias("end"), "event_id", "__row")
    ends = rows.select("client", (micros - seconds * 1_000_000).alias("at"), F.lit(1).alias("end"), "event_id", "__row")
    counted = global_totals(here.unionByName(ends), [F.col(c) for c in ("client", "at", "end", "event_id", "__row")], {"below": (F.lit(1) - F.col("end")).cast("long")})
    found = counted.groupBy("__row").agg((F.sum(F.when(F.col("end") == 0, F.col("below") + 1).otherwise(-F.col("below")))).alias("in_window"))
    return rows.join(found, "__row").drop("__row")


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """`blocked` requests count as well."""
    return window_counts(requests, seconds).withColumn("blocked", F.col("in_window") > limit)


def key_allowed(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Allowed while fewer than `limit` requests came before in the window."""
    return window_counts(requests, seconds).withColumn("allowed", F.col("in_window") - 1 < limit)


def polite_schedule(requests: DataFrame, by: str, delay: float, duration: str | None = None) -> DataFrame:
    """start_i = max(arrival_i, start_(i-1) + delay), in a closed form: running sum plus a running maximum.

    With a `duration` column the slot is held while it takes longer than the delay. Both compose over ranges of a
    group's requests, so that one site's queue is spread over tasks.
    """
    rows, order = in_ranges(requests, by, ["ts", "event_id"]), inside(by, ["ts", "event_id"])
    held = F.lit(float(delay)) if duration is None else F.greatest(F.lit(float(delay)), F.col(duration))
    rows = rows.withColumns({"arrival": F.unix_micros("ts") / F.lit(1e6), "__held": held})
    rows = rows.withColumn("__b", F.coalesce(F.sum("__held").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = written(rows.withColumn("__m", F.max(F.col("arrival") - F.col("__b")).over(order.rowsBetween(W.unboundedPreceding, 0))), "held")
    # a range hands on the sum of its slots, and how far its arrivals are ahead of these; the sums before shift the latter
    parts = rows.groupBy(by, "__p").agg(F.sum("__held").alias("__s"), F.max("__m").alias("__most"))
    parts = parts.withColumn("__o", F.coalesce(F.sum("__s").over(parts_before(by)), F.lit(0.0)))
    parts = parts.select(by, "__p", "__o", F.max(F.col("__most") - F.col("__o")).over(parts_before(by)).alias("__ahead"))
    out = with_parts(rows, parts, by)
    start = F.col("__b") + F.col("__o") + F.greatest(F.col("__m") - F.col("__o"), F.col("__ahead"))
    return out.withColumn("start", start).withColumn("wait", F.col("start") - F.col("arrival")).select(*requests.columns, "arrival", "start", "wait")


def degradation(requests: DataFrame, by: str, value: str, limit: float = 20.0, key: str = "event_id") -> DataFrame:
    """The mean of the second half against the first, in order of arrival.

    Places come from ranges of (by, ts, key), so that the requests of a path are spread over tasks.
    """
    placed = global_totals(requests.select(by, "ts", key, value), [F.col(by), F.col("ts"), F.col(key)], {"place": F.lit(1).cast("long")})
    heads = placed.groupBy(F.col(by).alias("__by")).agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    first = F.col("place") - F.col("start") < F.floor(F.col("n") / 2)
    halves = placed.join(heads, F.col(by).eqNullSafe(F.col("__by"))).select(by, value, first.alias("first"))
    out = halves.groupBy(by).agg(F.avg(F.when(F.col("first"), F.col(value))).alias("first_half"), F.avg(F.when(~F.col("first"), F.col(value))).alias("second_half"))
    change = F.when(F.col("first_half") > 0, F.lit(100.0) * (F.col("second_half") - F.col("first_half")) / F.col("first_half")).otherwise(0.0)
    return out.withColumn("change_percent", change).withColumn("degraded", F.col("change_percent") > limit)


#: Growth from one snapshot to the next beyond which a resource leaks, fixed values.
LEAK_FACTORS = {"memory_mb": 1.1, "open_files": 1.5, "threads": 1.2}


def _with_previous(df: DataFrame, by: str, order: list[str], value: Column) -> DataFrame:
    """Adds `__before`: `value` of the row before in its group; a range hands its last row on to the group's next."""
    rows = in_ranges(df.withColumn("__v", value), by, order)
    parts = rows.groupBy(by, "__p").agg(F.max_by(F.struct("__v"), F.struct(*order)).alias("__l"))
    parts = parts.select(by, "__p", F.lag("__l").over(W.partitionBy(by).orderBy("__p")).alias("__last"))
    own = inside(by, order)
    first = F.row_number().over(own) == 1
    out = with_parts(rows.withColumns({"__own": F.lag("__v").over(own), "__first": first}), parts, by)
    return out.select(*df.columns, F.when(F.col("__first"), F.col("__last.__v")).otherwise(F.col("__own")).alias("__before"))


def leaks(samples: DataFrame, by: str, ts: str, id_col: str, value: str, factor: float = 1.1) -> DataFrame:
    """W12 for one resource: samples that are over `factor` times the one before."""
    out = _with_previous(samples, by, [ts, id_col], F.col(value)).withColumnRenamed("__before", "before")
    return out.withColumn("leak", F.coalesce(F.col(value) > F.lit(factor) * F.col("before"), F.lit(False)))


def leak_warnings(snapshots: DataFrame, by: str, ts: str, key: str, factors: dict[str, float] = LEAK_FACTORS) -> DataFrame:
    """Adds `warnings`, the resources of `factors` that grew beyond their factor since the snapshot before."""
    out = _with_previous(snapshots, by, [ts, key], F.struct(*factors))
    grown = [F.when(F.col(c) > F.lit(f) * F.col("__before")[c], c) for c, f in factors.items()]
    return out.withColumn("warnings", F.array_compact(F.array(*grown))).drop("__before")


def fetch_stats(requests: DataFrame, by: str, delay: float = 1.0) -> DataFrame:
    """Fetches by domain: how many, the last time, and the delay that holds."""
    return requests.groupBy(by).agg(F.count(F.lit(1)).alias("fetches"), F.max("ts").alias("last_fetch"), F.lit(float(delay)).alias("delay"))


def last_rows(df: DataFrame, order: list[Column], n: int = 1000) -> DataFrame:
    """The last n rows of a history."""
    return df.orderBy(*order).limit(n)


def compare_averages(base: DataFrame, now: DataFrame, key: str, value: str, limit: float = 20.0) -> DataFrame:
    """Averages of two runs by key; over `limit` percent up is a regression, down an improvement."""
    mean = lambda df, name: df.groupBy(key).agg(F.avg(value).alias(name))
    both = mean(base, "baseline").join(mean(now, "current"), key, "full_outer")
    change = F.when((F.col("baseline") > 0) & (F.col("current") > 0), F.lit(100.0) * (F.col("current") - F.col("baseline")) / F.col("baseline"))
    kind = F.when(F.col("change_percent") > limit, "regression").when(F.col("change_percent") < -limit, "improvement").when(F.col("change_percent").isNotNull(), "unchanged").otherwise("missing")
    return both.withColumn("change_percent", change).withColumn("verdict", kind)


def compare_stages(base: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Totals of two runs by stage; a missing stage is 0, and against 0 any time is 100 percent more."""
    total = lambda df, name: df.groupBy(key).agg(F.sum(value).alias(name))
    both = total(base, "baseline").join(total(now, "current"), key, "full_outer").fillna(0.0, ["baseline", "current"])
    change = F.when(F.col("baseline") > 0, F.lit(100.0) * (F.col("current") - F.col("baseline")) / F.col("baseline")).when(F.col("current") > 0, 100.0).otherwise(0.0)
    return both.withColumns({"difference": F.col("current") - F.col("baseline"), "change_percent": change})


def advice(requests: DataFrame, memory: DataFrame | None = None, pools: DataFrame | None = None) -> DataFrame:
    """One row for each finding of the other analyses: slower second halves, over a tenth of outliers, few or slow
    cache hits, failures, memory that leaks (of `memory_growth`), pools that are full (of `pool_utilisation`).
    """
    finding = lambda df, where, text, name="scenario": df.where(where).select(F.col(name).cast("string").alias("scenario"), F.lit(text).alias("finding"))
    cache, load = cache_efficiency(requests), load_summary(requests)
    limits = written(load.select(F.col("scenario").alias("__s"), "p95"), "p95")
    beyond = requests.join(limits, F.col("scenario") == F.col("__s")).groupBy("scenario").agg((F.lit(100.0) * F.count_if(F.col("duration_ms") > F.col("p95")) / F.count(F.lit(1))).alias("outliers_percent"))
    parts = [
        finding(degradation(requests, "scenario", "duration_ms"), "degraded", "degradation"), finding(beyond, "outliers_percent > 10", "many outliers"), finding(cache, "low_hit_rate", "low cache hit rate"),
        finding(cache, "slow_hits", "cache hits are slow"), finding(load, "success_rate < 95", "failures"),
    ]
    if memory is not None:
        parts.append(finding(memory, "leak", "memory leak", memory.columns[0]))
    if pools is not None:
        parts.append(finding(pools, "saturated", "pool saturated", pools.columns[0]))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def version_metrics(runs: DataFrame) -> DataFrame:
    """By prompt type and version: uses, success rate, mean time, and mean confidence of the runs that have one."""
    return runs.groupBy("prompt_type", "version_id").agg(
        F.count(F.lit(1)).alias("uses"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("response_time").alias("mean_time"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"), F.max("created_at").alias("last_used"),
        F.min("created_at").alias("created_at"),
    )


def version_summary(metrics: DataFrame) -> DataFrame:
    """By prompt type, and of all in a row without type: versions, uses, success rate of all uses, mean of the mean times."""
    parts = metrics.cube("prompt_type").agg(
        F.count(F.lit(1)).alias("versions"), F.sum("uses").alias("total_uses"), F.try_divide(F.sum(F.col("success_rate") * F.col("uses")), F.sum("uses")).alias("success_rate"), F.avg("mean_time").alias("mean_time"), F.grouping("prompt_type").alias("all_types"),
    )
    return parts.withColumn("success_rate", F.coalesce("success_rate", F.lit(0.0)))


def best_versions(metrics: DataFrame, as_of: str, least_uses: int = 5, match: Column | None = None, active: Column | None = None) -> DataFrame:
    """Per type the active version of most 0.6 success + 0.4 confidence + recency + 0.2 match, 1 at most.

    Recency falls from 0.1 to 0 over 30 whole days since the version was made. Of equal scores the oldest version.
    """
    seconds = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("created_at")
    days = F.floor(seconds / F.lit(86_400_000_000))
    recency = F.greatest(F.lit(0.0), F.lit(1.0) - days / F.lit(30.0)) * F.lit(0.1)
    score = F.least(F.lit(1.0), F.lit(0.6) * F.col("success_rate") + F.lit(0.4) * F.col("mean_confidence") + recency + F.lit(0.2) * (F.lit(0.0) if match is None else match))
    scored = metrics.where((F.col("uses") >= least_uses) & (F.lit(True) if active is None else active)).withColumn("score", score)
    return scored.groupBy("prompt_type").agg(F.max_by("version_id", F.struct("score", -F.unix_micros("created_at"))).alias("version_id"), F.max("score").alias("score"))


def characteristics_match(actual: Column, expected: Column) -> Column:
    """The share of the numbers in map `expected` that map `actual` has within a fifth; of those in both."""
    both = F.filter(F.map_entries(expected), lambda e: F.map_contains_key(actual, e["key"]))
    near = F.filter(both, lambda e: F.abs(F.try_element_at(actual, e["key"]) - e["value"]) <= F.lit(0.2) * e["value"])
    return F.coalesce(F.try_divide(F.size(near), F.size(both)), F.lit(0.0))


def weighted_choice(rows: DataFrame, versions: DataFrame, row_id: str) -> DataFrame:
    """Each row takes a version by its weight: a hash of the row's id falls into the running sums of the weights.

    `versions` (version_id, weight) is a bounded configuration and is broadcast.
    """
    order = W.partitionBy(F.lit(0)).orderBy("version_id")
    upto = versions.select("version_id", F.sum("weight").over(order).alias("hi"), F.sum("weight").over(W.partitionBy(F.lit(0))).alias("total"), "weight")
    table = upto.agg(F.sort_array(F.collect_list(F.struct("hi", "version_id"))).alias("t"), F.max("total").alias("total"))
    # one row holds the table; rows meet it over a constant key
    keyed = rows.withColumn("__one", F.lit(1)).join(F.broadcast(table.withColumn("__one", F.lit(1))), "__one")
    point = F.pmod(F.xxhash64(row_id), F.lit(1_000_000)) / F.lit(1_000_000.0) * F.col("total")
    return keyed.withColumn("version_id", F.filter("t", lambda x: x["hi"] > point)[0]["version_id"]).drop("__one", "t", "total")
