"""A blocked Bloom filter as a table of a bounded number of rows, for broadcasts that let few rows past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many keys are broadcast themselves, in some 40 MB.
BROADCAST_KEYS = 500_000
#: Blocks of 256 bits, at most; 2**20 hold 30 million keys at 9 bits each, in 40 MB. More keys pass more rows.
MOST_BLOCKS = 1 << 20


def _block_and_masks(key: Column, blocks: int) -> dict[str, Column]:
    """The key's block, and four longs with two bits each: one bit in each of the block's eight 32-bit words."""
    bit = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 5 * i).bitwiseAND(F.lit(31))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (bit(i) + 32 * (i % 2)).cast("int"))
    masks = {f"__m{i}": one(2 * i).bitwiseOR(one(2 * i + 1)) for i in range(4)}
    return {"__block": F.xxhash64(key).bitwiseAND(F.lit(blocks - 1)), **masks}


def bloom_blocks(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """The filter of `count` keys as a table (__block, __f0..__f3) of at most MOST_BLOCKS rows, and the number of its blocks."""
    blocks = 64
    while blocks < MOST_BLOCKS and blocks * 256 < 12 * count:
        blocks *= 2
    rows = keys.select(*[c.alias(n) for n, c in _block_and_masks(F.col(key), blocks).items()])
    return rows.groupBy("__block").agg(*[F.bit_or(f"__m{i}").alias(f"__f{i}") for i in range(4)]), blocks


def with_maybe(df: DataFrame, key: Column, table: DataFrame, blocks: int) -> DataFrame:
    """Adds `__maybe`: false for keys that are not in the filter for sure. The filter is broadcast."""
    out = df.withColumns(_block_and_masks(key, blocks)).join(F.broadcast(table), "__block", "left")
    all_set = F.lit(True)
    for i in range(4):
        all_set &= F.coalesce(F.col(f"__f{i}").bitwiseAND(F.col(f"__m{i}")) == F.col(f"__m{i}"), F.lit(False))
    return out.withColumn("__maybe", all_set).drop("__block", *[f"__{k}{i}" for k in "fm" for i in range(4)])


def _named(df: DataFrame, keys: dict[str, Column], among: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """`df` with its keys, the different keys of `among`, and when they are equal; nulls are keys as others are."""
    named = df.withColumns({f"__key_{k}": c for k, c in keys.items()})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"__key_{k}").eqNullSafe(F.col(f"__out_{k}"))
    return named, among.select(*[F.col(k).alias(f"__out_{k}") for k in keys]).distinct(), on


def _with_maybe_among(named: DataFrame, keys: dict[str, Column], among: DataFrame, count: int) -> DataFrame:
    table, blocks = bloom_blocks(among.select(F.xxhash64(*keys).alias("__hash")), "__hash", count)
    return with_maybe(named, F.xxhash64(*[f"__key_{k}" for k in keys]), table, blocks)


def excluding(df: DataFrame, keys: dict[str, Column], excluded: DataFrame) -> DataFrame:
    """The rows of `df` whose keys are not among those of `excluded`, a written table with columns named as `keys`.

    Few excluded keys are broadcast. Of many only the Bloom filter is: rows that it does not hold for sure are not
    shuffled, and the others meet the keys themselves, at the price of a second scan.
    """
    named, alone, on = _named(df, keys, excluded)
    if (count := excluded.count()) <= BROADCAST_KEYS:
        return named.join(F.broadcast(alone), on, "left_anti").select(*df.columns)
    rows = _with_maybe_among(named, keys, excluded, count)
    return rows.where("not __maybe").select(*df.columns).unionByName(rows.where("__maybe").join(alone, on, "left_anti").select(*df.columns))


def including(df: DataFrame, keys: dict[str, Column], included: DataFrame) -> DataFrame:
    """The rows of `df` whose keys are among those of `included`; rows that the filter does not hold are not shuffled."""
    named, alone, on = _named(df, keys, included)
    if (count := included.count()) <= BROADCAST_KEYS:
        return named.join(F.broadcast(alone), on, "left_semi").select(*df.columns)
    return _with_maybe_among(named, keys, included, count).where("__maybe").join(alone, on, "left_semi").select(*df.columns)
