"""All pairs of similar sets of shingles: an exact prefix join, a bound from bits, and tiles compared inside tasks.

Sets are made from the texts where they are needed, and not stored: what is written of a text are its first shingles and
a bitmap of some two bits a shingle. Bits that differ count different shingles at least, so the bitmaps of two sets bound
what they share: candidates that cannot reach the similarity go before any set is shuffled. The others are dealt out in
tiles, so that a text is sent once for all its pairs in a tile, not once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators.bloom import BROADCAST_KEYS, including
from siltstone.sources.tables import dropped, written

#: One row in so many is looked at for frequent shingles; so many of these, at most, come last in the order of shingles.
LOOK, FREQUENT = 16, 4000
#: A group of more texts is dealt out in tiles, pairs of slices of about so many.
SLICE = 256
#: Texts whose shingles are held at once.
TOGETHER = 100
#: Shingles whose places in the texts of a tile are held at once.
COLUMNS = 4096


def _hashed(content: DataFrame, id_col: str) -> DataFrame:
    """(id, length, h): the hashes of the lower-cased words of each text."""
    text = F.coalesce("content", F.lit(""))
    return content.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("length"), F.transform(tx.words(F.lower(text)), lambda w: F.xxhash64(w)).alias("h"))


def _sets(words: pa.Array, size: int) -> list[np.ndarray]:
    """For each list of hashed words the different hashes of `size` in a row."""
    found = []
    for h in lists(words):
        h, n = h.view(np.uint64), max(1, len(h) - size + 1)
        sums = np.full(n, min(len(h), size), np.uint64)
        for k in range(min(size, len(h))):
            sums = sums * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            sums = (sums ^ (sums >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        found.append(np.unique(sums ^ (sums >> np.uint64(32))).view(np.int64))
    return found


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, TOGETHER):
            yield b.slice(at, TOGETHER)


def _listed(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))


def shingle_hashes(content: DataFrame, id_col: str, size: int) -> DataFrame:
    """(id, length, shingles): the different hashes of `size` words in a row, lower-cased; shorter texts have one.

    The words are hashed in the JVM, their sequences in numpy: as nested lambdas these would be worked out again for
    each word wherever a filter is pushed below them.
    """
    rows = _hashed(content, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _listed(_sets(b.column(2), size))], ["id", "length", "shingles"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, length bigint, shingles array<bigint>")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Two bits a shingle or more, 64 at least, a power of two: each shingle sets one."""
    size = 64
    while size < 2 * len(shingles):
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[shingles.view(np.uint64) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def most_common(a: np.ndarray, b: np.ndarray, n: int) -> int:
    """How many shingles two sets of `n` in all can share, by their bitmaps; the longer one is folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return (n - int(np.bitwise_count(a ^ b).sum())) // 2


def lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of longs of a column."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, by products of matrices of some columns at a time."""
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(len(sets)), sizes), np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, (at, at + COLUMNS))
        there = np.zeros((len(sets), COLUMNS), np.float32)
        there[row[low:high], column[low:high] - at] = 1
        common += there @ there.T
    return common


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, which they are sorted by."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        ends = (np.flatnonzero(np.diff(b.column(0).to_numpy())) + 1).tolist()
        if kept and b.num_rows and kept[-1].column(0)[-1] != b.column(0)[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        for begin, end in zip([0, *ends], [*ends, b.num_rows], strict=True):
            kept.append(b.slice(begin, end - begin))
            if end < b.num_rows:
                yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def _heads(content: DataFrame, similar: float, id_col: str, size: int) -> DataFrame:
    """(id, n, first, bits): the number of shingles, the first of them in an order with frequent ones last, the bitmap.

    Sets that similar share one of their first n - ceil(similar * n) + 1 shingles in any one order of all shingles. Which
    are frequent is seen in some of the rows, and decides how many candidates are looked at, not which pairs are found.
    """
    rows, some = _hashed(content, id_col).select("id", "h"), content.where(F.pmod(F.xxhash64(id_col), F.lit(LOOK)) == 0)
    seen = shingle_hashes(some, id_col, size).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    # a bounded number of longs
    often = np.array([r["s"] for r in seen.where("c > 2").orderBy(F.desc("c"), "s").limit(FREQUENT).collect()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            numbers, first, bits = [], [], []
            for s in _sets(b.column(1), size):
                last = np.isin(s, often)
                numbers.append(len(s))
                first.append(np.concatenate([np.sort(s[~last]), np.sort(s[last])])[: len(s) - int(np.ceil(len(s) * similar - 1e-9)) + 1])
                bits.append(bitmap(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int64()), _listed(first), pa.array(bits, pa.binary())], ["id", "n", "first", "bits"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, first array<bigint>, bits binary")


def candidates(content: DataFrame, similar: float, id_col: str, size: int) -> DataFrame:
    """(id_a, id_b): all pairs of texts whose shingles can have a Jaccard similarity of `similar`, and few others.

    Enough shingles are left in both from the first shared one on, and the bitmaps leave room for enough. Shingles that
    the same rows have stand for each other.
    """
    if similar <= 0:
        raise ValueError("all pairs are similar to a degree of 0: a join of pairs needs a greater one")
    heads = written(_heads(content, similar, id_col, size), "heads")
    entries = heads.select("id", "n", F.posexplode("first").alias("p", "s"))
    shared = written(entries.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("s"), "shared")
    common = written(including(entries, {"s": F.col("s")}, shared), "common")
    groups = written(common.groupBy("s").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("id")).alias("of")), "groups")
    kinds = written(common.join(groups, "s").groupBy("id", "n", "rows", "of").agg(F.min("p").alias("p")), "kinds")
    for df in (shared, common, groups):
        dropped(df)
    a, b = (kinds.select("rows", "of", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "p")]) for k in "ab")
    n = F.col("n_a") + F.col("n_b")
    left = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    enough = similar / (1.0 + similar)
    some = a.join(b, ["rows", "of"]).where((F.col("id_a") < F.col("id_b")) & (left >= F.lit(enough) * n - F.lit(1e-9)))
    some = written(some.where(F.least("n_a", "n_b") >= F.lit(similar) * F.greatest("n_a", "n_b") - F.lit(1e-9)).select("id_a", "id_b", n.alias("n")).distinct(), "some")
    asked = written(some.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "asked")
    bits = written(including(heads.select("id", "bits"), {"id": F.col("id")}, asked), "bits")
    dropped(heads)
    for k in "ab":
        some = some.join(bits.select(F.col("id").alias(f"id_{k}"), F.col("bits").alias(f"bits_{k}")), f"id_{k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)
            room = [most_common(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), m) >= enough * m - 1e-9 for m, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["id_a", "id_b"]).filter(pa.array(room, pa.bool_()))

    kind = heads.schema["id"].dataType.simpleString()
    return some.select("id_a", "id_b", "n", "bits_a", "bits_b").mapInArrow(run, f"id_a {kind}, id_b {kind}")


def similar_pairs(content: DataFrame, similar: float, id_col: str, size: int) -> DataFrame:
    """(id_a, id_b, jaccard, length_a, length_b): all pairs of texts of a similarity of `similar`, once each.

    A pair belongs to the group of the least partner of its first text; a large group is a tile for each two slices that
    have a pair. The sets are made anew for the texts that have pairs.
    """
    pairs = written(candidates(content, similar, id_col, size), "pairs")
    leads = written(pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).groupBy("id_a").agg(F.min("id_b").alias("m")).select("id_a", F.least("id_a", "m").alias("lead")), "leads")
    led = written(pairs.join(leads, "id_a"), "led")
    sizes = written(led.select("lead", F.explode(F.array("id_a", "id_b")).alias("id")).distinct().groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("long").alias("k")), "sizes")
    cut = lambda c: F.pmod(F.xxhash64(c), F.col("k"))
    dealt = led.join(sizes, "lead").select("id_a", "id_b", "lead", cut("id_a").alias("x"), cut("id_b").alias("y"))
    low, high = F.least("x", "y"), F.greatest("x", "y")
    ends = F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("x").alias("slice"), F.lit(True).alias("first")), F.struct(F.col("id_b").alias("id"), F.col("y").alias("slice"), F.lit(False).alias("first")))).alias("e")
    members = dealt.select(F.xxhash64("lead", low, high).alias("tile"), (low == high).alias("own"), ends).select("tile", "own", "e.*")
    placed = written(members.groupBy("tile", "own", "id", "slice").agg(F.max("first").alias("first")), "placed")
    asked = written(placed.select("id").distinct(), "asked")
    few = shingle_hashes(including(content, {"id": F.col(id_col)}, asked), id_col, size)
    rows = few.join(F.broadcast(placed) if placed.count() <= BROADCAST_KEYS else placed, "id").select("tile", "own", "id", "slice", "first", "length", "shingles")
    kind = few.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            found = lists(t.column("shingles").combine_chunks())
            ids, length, part, first = t.column("id").to_pylist(), t.column("length").to_numpy(), t.column("slice").to_numpy(), t.column("first").to_numpy()
            common, n = common_shingles(found).astype(np.float64), np.array([len(s) for s in found])
            jaccard = common / (n[:, None] + n[None, :] - common)
            # of the pairs of a tile only those that belong to it: the first text is one of the group, in slices of the tile
            near = (jaccard >= similar) & first[:, None] & (part[:, None] != part[None, :] if not t.column("own")[0].as_py() else True)
            i, j = (x.tolist() for x in np.nonzero(near))
            kept = [(x, y) for x, y in zip(i, j, strict=True) if ids[x] < ids[y]]
            i, j = [x for x, _ in kept], [y for _, y in kept]
            id_type = t.schema.field("id").type
            columns = [pa.array([ids[x] for x in i], id_type), pa.array([ids[y] for y in j], id_type), pa.array(jaccard[i, j] if i else [], pa.float64()), pa.array(length[i] if i else [], pa.int64()), pa.array(length[j] if j else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id_a", "id_b", "jaccard", "length_a", "length_b"])

    out = rows.repartition("tile").sortWithinPartitions("tile")
    return out.mapInArrow(run, f"id_a {kind}, id_b {kind}, jaccard double, length_a bigint, length_b bigint")
