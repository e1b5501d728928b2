"""Classes of near duplicates, by MinHash bands and exact checks, with spanning links in place of all pairs.

A text's signature holds the least of BANDS * ROWS hashes of its shingles; texts that agree in the ROWS numbers of a band
share a bucket. Two texts of a Jaccard similarity s do so in a share s ** ROWS of the bands: of pairs at 0.8 about one in
150,000 shares none. A bucket is not paired out. All of its texts are first compared with one of them, by their whole
sets of shingles: with the one that shares most buckets with others, as the original of edited copies does. Of buckets
with the same texts, as near copies have in most bands, one is looked at. Buckets of three texts or more that these links
leave in several parts are compared inside tasks: as tiles, pairs of slices, in which products of matrices
give the common shingles of all pairs at once, and what comes out are links between parts. So the links span the classes
that all pairs in buckets would give, and a group of k near copies of one text has about k of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.bloom import including
from siltstone.operators.components import connected_components
from siltstone.operators.dedup import SHINGLE, SIMILAR, singled
from siltstone.operators.pairs import SLICE, common_shingles, lists, runs
from siltstone.sources.tables import dropped, written

BANDS, ROWS = 30, 5
#: Texts that are hashed together, and shingles whose hashes are held at once.
TOGETHER, AT_ONCE = 100, 512

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of ASCII at which `str.split` cuts.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
#: The blanks beyond ASCII begin so in UTF-8.
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Masks of the first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_FACTORS = (_mixed(_mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _ODD)) | np.uint64(1)).astype(np.uint32)


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lower-cased words of all texts, as `str.split` finds them, and how many each text has.

    A word is hashed in parts of 8 bytes, those of all texts at once.
    """
    parts = [(t or "").lower().encode() for t in texts]
    parts = [p if p.isascii() or not any(w in p for w in _WIDE) else " ".join(p.decode().split()).encode() for p in parts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" " * 9, np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(begin, np.cumsum([1, *[len(p) + 1 for p in parts]])))
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    pieces = (end - begin + 7) // 8
    first = np.cumsum(pieces) - pieces
    place = np.arange(pieces.sum()) - np.repeat(first, pieces)
    at = np.repeat(begin, pieces) + 8 * place
    value = np.lib.stride_tricks.sliding_window_view(data, 8)[at].view("<u8")[:, 0] & _FIRST[np.minimum(np.repeat(end, pieces) - at, 8)]
    sums = np.add.reduceat(_mixed(value + (place + 1).astype(np.uint64) * _ODD), first)
    return _mixed(sums + (end - begin).astype(np.uint64) * _ODD), counts


def hashed_shingles(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the hashes of `size` lower-cased words in a row; of all its words, if these are fewer."""
    words, counts = hashed_words(texts)
    many = max(0, len(words) - size + 1)
    long = np.full(many, size, np.uint64)
    for k in range(size):
        long = long * _ODD + words[k : k + many]
    long, out, at = _mixed(long), [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(long[at : at + n - size + 1])
        else:
            sums = np.full(1, n, np.uint64)
            for k in range(n):
                sums = sums * _ODD + words[at + k]
            out.append(_mixed(sums))
        at += n
    return out


def _least(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of each hash of the shingles: products of their lower halves."""
    halves, least = shingles.astype(np.uint32), np.full(len(factors), np.uint32(0xFFFFFFFF))
    for at in range(0, len(halves), AT_ONCE):
        least = np.minimum(least, (halves[None, at : at + AT_ONCE] * factors[:, None]).min(axis=1))
    return least


def bands_of(found: list[np.ndarray]) -> np.ndarray:
    """The buckets of texts, by their shingles: a row for each text, a column for each band."""
    least = np.array([_least(s, _FACTORS) for s in found], np.uint64).reshape(len(found), BANDS, ROWS)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(found), axis=0)
    for r in range(ROWS):
        keys = _mixed(keys * _ODD + least[:, :, r])
    return keys


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The bucket of a text in each band."""
    return bands_of([shingles])[0]


def _by_text(texts: DataFrame, id_col: str, size: int, of: str) -> DataFrame:
    """(id, keys) or (id, length, shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                found = hashed_shingles(part.column(1).to_pylist(), size)
                if of == "keys":
                    lists = list(bands_of(found))
                else:
                    lists = [np.unique(s) for s in found]
                offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), values], ["id", "length", of])

    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.select(F.col(id_col), "content", F.length(F.coalesce("content", F.lit(""))).cast("long"))
    return rows.mapInArrow(run, f"id {kind}, length bigint, {of} array<bigint>")


def _spanned(content: DataFrame, prints: DataFrame, similar: float, id_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """The links of `near_links`, and the components that they make: (node, component)."""
    if similar < 0.5:
        raise ValueError("bands find similarities of 0.5 or more")
    texts = singled(content.select(id_col, "content"), prints, id_col)
    entries = written(_by_text(texts, id_col, size, "keys").select("id", F.explode("keys").alias("key")), "entries")
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("of")).where("n > 1")
    shared = written(buckets.groupBy("n", "of").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times")).drop("of"), "shared")
    sharing = written(entries.join(shared, "key"), "sharing")
    dropped(entries)
    central = written(sharing.groupBy("id").agg(F.sum(F.col("n") * F.col("times")).alias("score")), "central")
    among = written(sharing.join(central, "id").select("key", "id", "score"), "among")
    dropped(sharing)
    asked = written(among.select("id").distinct(), "asked")
    sets = written(_by_text(including(texts, {"id": F.col(id_col)}, asked), id_col, size, "shingles"), "sets")
    a, b = (sets.select(F.col("id").alias(f"id_{k}"), F.col("shingles").alias(f"s{k}"), F.col("length").alias(f"length_{k}")) for k in "ab")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(a, "id_a").join(b, "id_b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        both = both.withColumn("jaccard", F.col("common") / (F.size("sa") + F.size("sb") - F.col("common")))
        longer = F.greatest(F.lit(1), "length_a", "length_b")
        return both.select("id_a", "id_b", "jaccard", (F.lit(1.0) - F.abs(F.col("length_a") - F.col("length_b")) / longer).alias("length_score"))

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b")]

    leads = written(among.groupBy("key").agg(F.max_by("id", F.struct("score", "id")).alias("lead")), "leads")
    pairs = among.join(leads, "key").where("id <> lead").select(*ordered("id", "lead")).distinct()
    star = written(verified(pairs).where(F.col("jaccard") >= similar), "star")
    parts = written(connected_components(star, "id_a", "id_b"), "parts")
    placed = written(among.join(parts, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("part")), "placed")
    dropped(among)
    split = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2")
    open_ = written(placed.join(written(split.select("key", "n"), "split"), "key"), "open")
    dropped(placed)
    if open_.isEmpty():
        return star, parts
    across = _tile_links(open_, sets, similar).groupBy("id_a", "id_b").agg(F.min("jaccard").alias("jaccard"), F.min("length_score").alias("length_score"))
    links = written(star.unionByName(across), "links")
    return links, written(connected_components(links, "id_a", "id_b"), "parts")


def _tile_links(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links between the parts of buckets, of (key, id, part, n): each pair of slices of a bucket is a tile of its own."""
    slices = F.ceil(F.col("n") / SLICE).cast("long")
    own = members.withColumn("__k", slices).withColumn("__s", F.pmod(F.xxhash64("id"), F.col("__k")))
    dealt = own.select("key", "id", "part", "__k", "__s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)).alias("__o"))
    tile = F.xxhash64("key", F.least("__s", "__o"), F.greatest("__s", "__o"))
    rows = dealt.select(tile.alias("tile"), "id", "part").join(sets, "id").select("tile", "id", F.xxhash64("part").alias("part"), "length", "shingles")
    names = ["id_a", "id_b", "jaccard", "length_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            i, j, jaccard = _spanning(lists(t.column("shingles").combine_chunks()), t.column("part").to_numpy(), similar)
            ids, n = t.column("id").to_pylist(), t.column("length").to_numpy()
            first = [min(ids[x], ids[y]) for x, y in zip(i, j, strict=True)]
            last = [max(ids[x], ids[y]) for x, y in zip(i, j, strict=True)]
            score = 1.0 - np.abs(n[i] - n[j]) / np.maximum(1, np.maximum(n[i], n[j]))
            yield pa.RecordBatch.from_arrays([pa.array(first, t.schema.field("id").type), pa.array(last, t.schema.field("id").type), pa.array(jaccard, pa.float64()), pa.array(score, pa.float64())], names)

    kind = sets.schema["id"].dataType.simpleString()
    dealt = rows.repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, f"id_a {kind}, id_b {kind}, jaccard double, length_score double")


def _spanning(sets: list[np.ndarray], part: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets of different parts, by place, of a similarity of `similar`, as many as it takes to join what they join."""
    if (part == part[0]).all():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    sizes = np.array([len(s) for s in sets])
    common = common_shingles(sets)
    jaccard = common.astype(np.float64) / (sizes[:, None] + sizes[None, :] - common)
    near = jaccard >= similar
    root, i, j = part.copy(), [], []
    for x in range(len(sets)):
        others = np.flatnonzero(near[x] & (root != root[x]))
        for r, y in dict(zip(root[others].tolist(), others.tolist(), strict=True)).items():
            i.append(x)
            j.append(y)
            root[root == r] = root[x]
    return np.array(i, int), np.array(j, int), jaccard[i, j] if i else np.zeros(0)


def near_links(content: DataFrame, prints: DataFrame, similar: float = SIMILAR, id_col: str = "_id", size: int = SHINGLE) -> DataFrame:
    """(id_a, id_b, jaccard, length_score): links between different texts of a similarity of `similar` that span their classes.

    The least id of a text stands for its copies. Null texts count as empty. `similar` is 0.5 or more: bands would miss
    too many less similar pairs. No rows: none.
    """
    return _spanned(content, prints, similar, id_col, size)[0]


def near_classes(content: DataFrame, prints: DataFrame, similar: float = SIMILAR, id_col: str = "_id") -> DataFrame:
    """D5 as membership: a row per row of content: id, text_id, class_id, near_links.

    text_id is the least id of an equal text, class_id the least id that equal texts and links between near ones reach,
    near_links the number of links of the row's text that were found on the way, which span the class. No rows: none.
    """
    links, parts = _spanned(content, prints, similar, id_col, SHINGLE)
    least = written(prints.groupBy("text_fp").agg(F.min("id").alias("text_id")), "least")
    degree = links.select(F.explode(F.array("id_a", "id_b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("near_links"))
    named = least.join(parts.join(degree, "node"), F.col("text_id") == F.col("node"), "left")
    named = written(named.select("text_fp", "text_id", F.coalesce("component", "text_id").alias("class_id"), F.coalesce("near_links", F.lit(0)).cast("long").alias("near_links")), "named")
    return prints.join(named, "text_fp").select("id", "text_id", "class_id", "near_links")
