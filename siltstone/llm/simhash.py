"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at few differing bits by bit-sliced comparison.

Fingerprints are cut into blocks of bits; two that differ in at most RADIUS bits agree on all but RADIUS blocks, so that
a table for each choice of the other blocks finds every link. Inside a bucket of a table fingerprints are stored
vertically, a plane for each bit, and a word operation brings 64 distances on by one bit in carry-save counters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import text_or_empty
from siltstone.operators.bloom import excluding
from siltstone.operators.components import connected_components
from siltstone.sources.tables import dropped, written

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a block, whose distances to each other are found together; small buckets share one.
LANES = 512
#: A bucket of more fingerprints is dealt out in tiles, pairs of slices of about so many.
SLICE = 1024
#: Buckets of a table should have less than so many fingerprints, if these were even: more blocks of bits give smaller ones.
BUCKET = 1024


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of the text's words, lower-cased for A-Z; fewer words make one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :] or ends[-1:], strict=False)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """0 for a text without words."""
    return majority(np.array(shingle_hashes(text or "", size, seed), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(__id, fp, __raw): the fingerprint of each row, as a signed long, and a hash of its text as given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], ["__id", "fp", "__raw"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col), F.xxhash64(text_or_empty(text_col)))
    return rows.mapInArrow(run, f"__id {kind}, fp bigint, __raw bigint")


def tables_for(count: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that each table's key keeps: enough blocks that even buckets hold less than BUCKET of `count`."""
    for blocks in range(radius + 1, 2 * radius + 2):
        edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
        masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in kept) for kept in combinations(range(blocks), blocks - radius)]
        if count <= BUCKET << min(m.bit_count() for m in masks):
            break
    return masks


class Slices:
    """Bit planes of fingerprints, one lane each."""

    def __init__(self, fps: np.ndarray):
        self.n = len(fps)
        self.words = -(-self.n // 64)
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lane, bit
        self.masks = bits.T.astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)  # a query's bit, in all lanes
        padded = np.zeros((BITS, self.words * 64), np.uint8)
        padded[:, : self.n] = bits.T
        self.planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)  # bit, word of lanes

    def near(self, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Lanes (a, b), a < b, at distance `radius` at most, of the queries a from first to last.

        Counters start so far up that they run over just past the radius. Every few bits, queries all of whose lanes
        are over are abandoned.
        """
        width = max(1, math.ceil(math.log2(radius + 1)))
        start = (1 << width) - 1 - radius
        queries = np.arange(first, last)
        lanes = np.arange(self.words * 64)
        skip = (lanes[None, :] <= queries[:, None]) | (lanes >= self.n)[None, :]
        over = np.packbits(skip, axis=1, bitorder="little").view(np.uint64)
        counter = [np.full(over.shape, np.uint64(0xFFFFFFFFFFFFFFFF if start >> i & 1 else 0)) for i in range(width)]
        for j in range(BITS):
            carry = self.planes[j][None, :] ^ self.masks[j][queries][:, None]
            for i in range(width):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            over |= carry
            if j >= 7 and j % 4 == 3:
                alive = (over != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
                if not alive.any():
                    return np.empty(0, np.int64), np.empty(0, np.int64)
                if not alive.all():
                    queries, over, counter = queries[alive], over[alive], [c[alive] for c in counter]
        row, lane = np.nonzero(np.unpackbits(~over.view(np.uint8), axis=1, bitorder="little"))
        return queries[row], lane


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n lanes the least one of its component by the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = root[a], root[b]
            different = x != y
            a, b, x, y = a[different], b[different], x[different], y[different]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (after := root[root]).tolist() != root.tolist():
                root = after
    return root


def block_links(fps: np.ndarray, radius: int = RADIUS, queries: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a block of fingerprints; as many as it has lanes, at most."""
    planes = Slices(fps)
    root = forest(len(fps), (planes.near(at, min(at + queries, len(fps)), radius) for at in range(0, len(fps), queries)))
    lanes = np.flatnonzero(root != np.arange(len(fps)))
    return fps[lanes], fps[root[lanes]]


def bucket_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links inside the buckets of rows (bucket, fp), dealt by bucket and sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
            for b in batches:
                keys, fps = np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([fps, b.column(1).to_numpy()])
                ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                done = 0
                while len(later := ends[ends > done]) and len(fps) - done > LANES:
                    fit = later[later <= done + LANES]
                    end = fit[-1] if len(fit) else later[0]
                    yield fps[done:end]
                    done = end
                keys, fps = keys[done:], fps[done:]
            if len(fps):
                yield fps

        for fps in blocks():
            a, b = block_links(np.unique(fps.view(np.uint64)), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints `fp` of `nodes` that any links at `radius` bits connect.

    A bucket of over SLICE fingerprints is cut into slices by a hash, and each pair of slices is a bucket of its own, so
    that no task holds more than two slices of it.
    """
    masks = tables_for(count, radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(keys).alias("bucket"))
    sizes = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE), "large")
    slices = F.coalesce(F.ceil(F.col("n") / SLICE), F.lit(1)).cast("long")
    # few keys can be large: at most count * tables / SLICE
    dealt = rows.join(sizes, "bucket", "left").withColumn("__k", slices)
    own = F.pmod(F.xxhash64(F.lit("slice"), F.col("fp")), F.col("__k"))
    dealt = dealt.withColumn("__s", own).select("fp", "bucket", "__s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)).alias("__o"), "__k")
    tile = F.when(F.col("__k") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("__s", "__o"), F.greatest("__s", "__o")))
    dealt = dealt.select(tile.alias("bucket"), "fp")
    return bucket_links(dealt.repartition("bucket").sortWithinPartitions("bucket"), radius)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """(__id, fp, component, __raw) for each row of `docs`: component is the least id that links reach, __raw a hash of the text.

    Texts without words have fingerprint 0 and are linked like any others; null texts count as empty. Repeated rows
    come out as often. Null ids have their links too, and are never the least where there are others. No rows: none.
    """
    prints = written(fingerprints(docs, id_col, text_col, size), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("__id").alias("__least")), "nodes")
    found = written(links(nodes, nodes.count(), radius), "links")
    # in ids: the least id of a fingerprint names it, and a component's least is its least name
    comps = connected_components(found)
    members = nodes.join(written(comps, "members"), nodes["fp"] == F.col("node"), "left").select("fp", "__least", F.coalesce("component", "fp").alias("__c"))
    members = written(members, "grouped")
    least = written(members.groupBy("__c").agg(F.min("__least").alias("component")), "least")
    named = written(members.join(least, "__c").select("fp", "component"), "named")
    out = prints.join(named, "fp")
    dropped(members)
    return out.select("__id", "fp", "component", "__raw")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay: of each group those with its least id.

    Rows are told apart by id and text, so that an id, or null, with several texts is as many documents. Where a group's
    least id comes several times in it, all of these rows stay.
    """
    groups = near_groups(docs, id_col, text_col, radius).where(~F.col("__id").eqNullSafe(F.col("component")))
    keys = {"__id": F.col(id_col), "__raw": F.xxhash64(text_or_empty(text_col))}
    return excluding(docs, keys, written(groups.select("__id", "__raw").distinct(), "dropped"))


def op7_query(docs: DataFrame) -> DataFrame:
    out = near_groups(docs)
    return out.select(F.col("__id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
