"""Mixing sources to target weights by a time-varying curriculum.

A source has a share of the token budget and a schedule: a piecewise-linear rate over training time 0..1. The integral
of the rate, scaled to the source's target, is its cumulative token demand D(t). The source's documents, in the order
of a hash, lie one after another on the token axis, once an epoch; a copy that begins at token x is due at the time
D^-1(x), and documents are range-sorted by that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from siltstone.llm.common import WORD, text_or_empty
from siltstone.operators.prefix import global_rank, global_totals, running_total
from siltstone.sources.tables import written

Schedule = Sequence[tuple[float, float]]

WEIGHTS = (5, 2, 1)
#: Rates at times from 0 to 1, one for each weight: the heavy sources lead early, the light ones late.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.4), (0.5, 1.1), (1.0, 0.4)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 0.9), (1.0, 1.8)))
#: Up to so many sources their table is broadcast (under 8 MB); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def order_hash(id_col: str) -> Column:
    """What a source's documents are ordered by, as an unsigned number."""
    return F.xxhash64(F.col(id_col).cast("string"))


def time_of_share(share: Column, schedule: Schedule) -> Column:
    """The time by which a schedule has given out `share` (0..1) of its tokens: the inverse of its integral.

    Between two knots the integral is a parabola, so that the inverse has a closed form.
    """
    pieces = [(t0, r0, t1, r1, (t1 - t0) * (r0 + r1) / 2) for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False)]
    whole = sum(p[-1] for p in pieces)
    out, done = F.lit(1.0), whole
    for t0, r0, t1, r1, area in reversed(pieces):
        done -= area
        left = share * F.lit(whole) - F.lit(done)
        slope = (r1 - r0) / (t1 - t0)
        root = F.try_divide(F.lit(2.0) * left, F.lit(r0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(r0 * r0) + F.lit(2 * slope) * left)))
        out = F.when(share * F.lit(whole) <= F.lit(done + area), F.lit(t0) + F.coalesce(root, F.lit(0.0))).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds `target` to (source, source_size, source_rank).

    Shares are by weight; what a source's cap cuts off goes to the others, until none is above. That is least(cap *
    size, level * weight) for one level. In the order of caps over weights the capped sources come first, so that the
    first source that the rest of the budget leaves at or under its cap gives the level.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    base = sources.withColumns({"__w": weight, "__most": F.lit(float(cap)) * F.col("source_size")}).withColumn("__full", F.col("__most") / F.col("__w"))
    base = written(global_totals(base, [F.col("__full"), F.col("source_rank")], {"__before": F.col("__most"), "__weight": F.col("__w")}), "weighted")
    size, all_weights = base.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("__w")).first()
    base = base.withColumn("__level", (F.lit(share * size) - F.col("__before")) / (F.lit(all_weights) - F.col("__weight")))
    level = base.where("__level <= __full").agg(F.min_by("__level", F.struct("__full", "source_rank"))).first()[0]
    target = F.col("__most") if level is None else F.least(F.col("__most"), F.lit(level) * F.col("__w"))
    return base.withColumn("target", target).drop("__w", "__most", "__full", "__before", "__weight", "__level")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    share: float = 1.5,
    cap: float = 2.0,
    ties: Sequence[str] = (),
) -> DataFrame:
    """`docs` with size, source_size, target, copies, taken and positions (training times of the copies, ascending).

    Sources rank by code point, null last, and take `weights` and `schedules` in turn. A copy is taken if its middle
    lies before the source's target, so that taken words miss the target by half a document at most and no document
    is taken more than ceil(cap) times. Sizes: words of `text`, null 0; documents of size 0 have copies where their
    place is before the target, and add nothing. Rows with the same id, and the same size or values of `ties`, take
    either place; null ids too. No rows: none. Columns of `docs` with the names of added ones are replaced; names that begin with two underscores are
    this operator's. Its result depends on ids, sources and sizes alone.
    """
    size = F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long") if size is None else size
    docs = docs.drop("source_size", "target", "copies", "taken", "positions").withColumns({"size": size, "__h": order_hash(id_col)})
    totals = written(docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n")), "sources")
    rows, kinds = totals.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1))).first()
    ranked = global_rank(totals, [F.col("__source").asc_nulls_last()], "source_rank")
    goals = written(source_targets(ranked.drop("__n"), weights, share, cap), "targets")
    goals = F.broadcast(goals) if kinds <= BROADCAST_SOURCES else goals
    docs = docs.join(goals, docs[source_col].eqNullSafe(goals["__source"])).drop("__source")
    docs = running_total(docs, ["source_rank"], "__h", [id_col, *(ties or ["size"])], F.col("size"), rows, "__at")
    epochs = F.transform(F.array(*[F.lit(e) for e in range(-(-int(cap * 1000) // 1000))]), lambda e: F.col("__at") + e * F.col("source_size"))
    begun = F.filter(epochs, lambda at: (at + F.col("size") / 2 <= F.col("target")) & (at < F.col("target")))
    due = lambda at: F.element_at(F.array(*[time_of_share(at / F.col("target"), s) for s in schedules]), (F.col("source_rank") % len(schedules) + 1).cast("int"))
    docs = docs.withColumn("__begun", begun)
    docs = docs.withColumns({"copies": F.size("__begun"), "taken": (F.size("__begun") * F.col("size")).cast("long"), "positions": F.transform("__begun", due)})
    return docs.drop("__h", "__at", "__begun", "source_rank")


def in_training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each copy that the mix takes, with its `position`, range-sorted by it."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", F.xxhash64(F.col(id_col).cast("string")), id_col)


def taken_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cap: float = 2.0, **how) -> DataFrame:
    """The rows of `docs` that the mix takes, once for each copy, with their columns, in no order.

    In each epoch a source takes a beginning of its documents in the order of hashes. So thin rows are placed, the last
    one taken is each source's bound for that epoch, and whole rows are compared with the bounds of their source:
    texts are not shuffled. Rows that are equal in all columns are taken as often together as the mix takes them.
    `how` goes to `mix_sources`, with nulls, ties and empty tables as there. No column may begin with two underscores.
    """
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    named = docs.withColumns({"__key": order_hash(id_col), "__row": F.xxhash64(*plain)})
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    thin = written(named.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__from"), size.alias("size"), "__row"), "sizes")
    placed = mix_sources(thin, "__id", "__from", F.col("size"), cap=cap, ties=["__row"], **how)
    # unsigned hashes in signed order
    order = lambda key, i: F.struct(key.bitwiseXOR(F.lit(-(1 << 63))).alias("h"), F.col(i).alias("id"), F.col("__row").alias("row"))
    placed = written(placed.select("__from", "copies", order(order_hash("__id"), "__id").alias("__o")), "placed")
    epochs = range(-(-int(cap * 1000) // 1000))
    bounds = written(placed.groupBy("__from").agg(*[F.max(F.when(F.col("copies") > e, F.col("__o"))).alias(f"__b{e}") for e in epochs]), "bounds")
    small = bounds.count() <= BROADCAST_SOURCES
    bounds = F.broadcast(bounds) if small else bounds
    whole = named.withColumns({"__o": order(F.col("__key"), id_col)}).join(bounds, named[source_col].eqNullSafe(bounds["__from"])).drop("__from", "__key", "__row")
    within = lambda less: sum((F.coalesce(less(F.col("__o"), F.col(f"__b{e}")), F.lit(False)).cast("int") for e in epochs), F.lit(0))
    at_bound = within(lambda o, b: o == b) > 0
    copied = lambda rows, n: rows.withColumn("__n", F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)
    # a bound may be one of several equal rows, of which some are taken
    edges = placed.join(bounds.withColumnRenamed("__from", "__s"), F.col("__from").eqNullSafe(F.col("__s"))).where(at_bound)
    edges = written(edges.groupBy("__from", "__o").agg(F.count(F.lit(1)).alias("__rows"), F.sum("copies").alias("__taken"), F.max("copies").alias("__each")), "edges")
    if edges.where(F.col("__taken") < F.col("__rows") * F.col("__each")).isEmpty():
        n = within(lambda o, b: o <= b)
        return copied(whole.where(n > 0), n)
    n = within(lambda o, b: o < b)
    inner = copied(whole.where((n > 0) & ~at_bound), n)
    edges = edges.select("__from", F.col("__o").alias("__at"), "__taken")
    edge = whole.where(at_bound).dropDuplicates([source_col, "__o"])
    edge = edge.join(F.broadcast(edges) if small else edges, edge[source_col].eqNullSafe(F.col("__from")) & (F.col("__o") == F.col("__at")))
    # the copies of one row, in lots that go to different tasks
    lots = edge.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(__taken - 1) div 65536")))).repartition("__at", "__lot")
    return inner.unionByName(copied(lots, F.least(F.lit(65536), F.col("__taken") - 65536 * F.col("__lot")).cast("int")))


def op4_query(docs: DataFrame) -> DataFrame:
    """One row per document, in the order of first use; those the mix leaves out come last, with no position."""
    thin = docs.select("doc_id", "source", F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size"))
    mixed = mix_sources(written(thin, "sizes"), size=F.col("size"))
    first, last = F.get("positions", 0), F.when(F.size("positions") > 1, F.element_at("positions", -1))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("position"), last.alias("last_position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")
