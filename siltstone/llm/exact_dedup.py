"""Exact dedup by composable polynomial fingerprints, with a chunkwise comparison of what has equal ones.

The fingerprint of bytes x_0..x_n-1 is the sum of x_i * BASE^(n-1-i), modulo two primes, with the length. Hashes of
neighbouring chunks combine: H(ab) = H(a) * BASE^len(b) + H(b). So texts of any length are hashed in chunks; a huge
text's chunks are rows of their own that several tasks hash, and a sum of length-shifted hashes puts them together.
Documents with equal fingerprints are then compared chunk by chunk: all chunks of a number are equal if the least is
the greatest, which Spark finds with partial aggregates, whatever the number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ascii_lower, slices, text_or_empty
from siltstone.operators.bloom import bloom_blocks, excluding, including, with_maybe
from siltstone.sources.tables import written

PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
#: Bytes that are hashed in one go, and the size of the chunks of a comparison.
CHUNK = 1 << 16
#: Texts of more bytes are hashed by several tasks.
HUGE = 1 << 24


class Hasher:
    """Polynomial hashes of bytes; `primes` under 2**31, smaller ones for tests of collisions."""

    def __init__(self, primes: tuple[int, int] = PRIMES, chunk: int = CHUNK):
        self.primes, self.chunk = primes, chunk
        self.powers = []
        for p in primes:
            power = np.ones(chunk, np.int64)
            for n in range(1, chunk):
                power[n] = int(power[n - 1]) * BASE % p
            self.powers.append(power[::-1].copy())

    def chunk_hash(self, data: np.ndarray, k: int) -> int:
        """The hash of a chunk at most: terms under 2**39, 2**16 of them, fit in 64 bits."""
        return int(np.dot(data.astype(np.int64), self.powers[k][self.chunk - len(data) :])) % self.primes[k]

    def shifted(self, h: int, length: int, k: int) -> int:
        """The hash of the same bytes before `length` others."""
        return h * pow(BASE, length, self.primes[k]) % self.primes[k]

    def hash(self, data: bytes) -> tuple[int, int]:
        x, out = np.frombuffer(data, np.uint8), []
        for k, p in enumerate(self.primes):
            h = 0
            for at in range(0, len(x), self.chunk):
                part = x[at : at + self.chunk]
                h = (self.shifted(h, len(part), k) + self.chunk_hash(part, k)) % p
            out.append(h)
        return out[0], out[1]


def _fingerprints(docs: DataFrame, hasher: tuple[tuple[int, int], int]) -> DataFrame:
    """(__id, __raw, n, h0, h1, sha) of texts that one task hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = Hasher(*hasher).hash
        for b in slices(batches):
            texts = [(t or b"").lower() for t in b.column(2).to_pylist()]
            hashes = [hash_of(t) for t in texts]
            columns = [b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "__raw", "n", "h0", "h1", "sha"])

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.select("__id", "__raw", F.encode("__text", "utf-8").alias("t")).mapInArrow(run, f"__id {kind}, __raw bigint, n bigint, h0 bigint, h1 bigint, sha binary")


def _huge_fingerprints(docs: DataFrame, hasher: tuple[tuple[int, int], int], piece: int) -> DataFrame:
    """The same for huge texts: pieces of `piece` bytes are rows, dealt out, hashed and summed with their shifts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hasher(*hasher)
        for b in batches:
            rest, pieces = b.column(3).to_pylist(), b.column(4).to_pylist()
            hashes = [own.hash(x) for x in pieces]
            out = [pa.array([own.shifted(h[k], r, k) for h, r in zip(hashes, rest, strict=True)], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], b.column(5), b.column(6), *out], ["__id", "__raw", "n", "sha", "__row", "h0", "h1"])

    kind = docs.schema["__id"].dataType.simpleString()
    data = docs.select("__id", "__raw", F.encode(ascii_lower(F.col("__text")), "utf-8").alias("t")).withColumn("__row", F.monotonically_increasing_id())
    data = data.select("*", F.octet_length("t").cast("long").alias("n"), F.unhex(F.sha2("t", 256)).alias("sha"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(piece).cast("long")))
    rows = data.select("*", at.alias("at")).select("__id", "__raw", "n", F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("at") - piece).alias("rest"), F.substr("t", (F.col("at") + 1).cast("int"), F.lit(piece)).alias("piece"), "sha", "__row", "at")
    rows = rows.repartition("__id", "__raw", "at").drop("at")
    rows = rows.mapInArrow(run, f"__id {kind}, __raw bigint, n bigint, sha binary, __row bigint, h0 bigint, h1 bigint")
    summed = rows.groupBy("__id", "__raw", "n", "sha", "__row").agg(F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).drop("__row")
    return summed.withColumns({f"h{k}": F.col(f"h{k}") % hasher[0][k] for k in (0, 1)})


def _unequal(docs: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """Fingerprints (n, h0, h1) whose members do not all have the same bytes: their chunks are compared in streams.

    Texts meet their fingerprints by a hash of id and text; a Bloom filter keeps the others out of the shuffle.
    """
    wanted = written(members.select(_row_hash().alias("__key"), "n", "h0", "h1").distinct(), "wanted")
    table, blocks = bloom_blocks(wanted, "__key", wanted.count())
    both = with_maybe(docs.select(_row_hash().alias("__key"), "__text"), F.col("__key"), table, blocks).where("__maybe").join(wanted, "__key")
    both = both.withColumn("__bytes", F.encode(ascii_lower(F.col("__text")), "utf-8")).where(F.octet_length("__bytes") == F.col("n"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(chunk).cast("long"))).alias("at")
    chunks = both.select("n", "h0", "h1", "__bytes", at).withColumn("c", F.substr("__bytes", (F.col("at") + 1).cast("int"), F.lit(chunk))).drop("__bytes")
    return chunks.groupBy("n", "h0", "h1", "at").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a != b").select("n", "h0", "h1").distinct()


def _row_hash() -> Column:
    """Of the id, null ids too, and the text's hash."""
    return F.xxhash64(F.col("__id").cast("string"), "__raw")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes: tuple[int, int] = PRIMES, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """One row per row of `docs`: __id, keep_id, group_size, kept, text_sha256 and __raw, a hash of the text as given.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays, null ids last; of rows that are equal in id and text one stays. No rows: none.
    """
    docs = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")).withColumn("__raw", F.xxhash64("__text"))
    size = F.octet_length("__text")
    hasher = (primes, chunk)
    prints = _fingerprints(docs.where(size <= huge), hasher).unionByName(_huge_fingerprints(docs.where(size > huge), hasher, huge))
    prints = written(prints.withColumn("__row", F.monotonically_increasing_id()), "prints")
    several = written(prints.groupBy("n", "h0", "h1").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").drop("__c"), "several")
    wrong = written(_unequal(docs, prints.join(several, ["n", "h0", "h1"], "left_semi"), chunk), "wrong")
    # where a fingerprint stands for different texts, their digests tell them apart
    prints = prints.join(wrong.withColumn("__wrong", F.lit(True)), ["n", "h0", "h1"], "left")
    prints = prints.withColumn("__part", F.when(F.col("__wrong"), F.col("sha")).otherwise(F.lit(b""))).drop("__wrong")
    key = ["n", "h0", "h1", "__part"]
    best = written(prints.groupBy(*key).agg(F.max(F.struct("__id", "__raw", "__row")).alias("__top"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = prints.join(best, key)
    return out.select("__id", F.col("__top.__id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__top.__row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "__raw")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    A row is found again by its id and the hash of its text; of rows that are equal in both, one stays.
    """
    groups = written(exact_groups(docs, id_col, text_col), "exact")
    rows = written(groups.groupBy("__id", "__raw").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows")), "rows")
    keys = {"__id": F.col(id_col), "__raw": F.xxhash64(text_or_empty(text_col))}
    found = excluding(docs, keys, written(rows.where("not stays").select("__id", "__raw"), "dropped"))
    twice = written(rows.where("stays and rows > 1").select("__id", "__raw"), "twice")
    if twice.isEmpty():
        return found
    once = including(found, keys, twice).withColumn("__key", keys["__raw"]).dropDuplicates([id_col, "__key"]).drop("__key")
    return excluding(found, keys, twice).unionByName(once)


def op3_query(docs: DataFrame) -> DataFrame:
    out = exact_groups(docs.select("doc_id", "text"))
    return out.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from t
"""
