"""Best-fit packing by a histogram of lengths.

Token sequences are cut into pieces of at most CAPACITY tokens. The plan is made from the counts of each length alone:
best fit, longest first, moves whole ranges of sequences at a time, so that its work and size depend on the capacity,
not on the number of documents. Pieces then take planned slots by their rank within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import slices, text_or_empty
from siltstone.operators.prefix import running_total
from siltstone.sources.tables import written

CAPACITY = 2048
END_ID = 0
#: Longer texts are encoded in parts of about so many characters.
PART = 1 << 20
#: A single space or newline between two characters that are not white space ends a pre-token, so that text may be cut there.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: The split of the byte-level pre-tokenizer, and the bytes that it writes as the characters of the same number.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Runs on which the split may go back too often for the fast library.
LONG_RUN = re.compile(r"\s{1000}")


def ranks_of(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file as ranks of byte strings; None where that would not be the same thing.

    It is if nothing normalises or adds to the text, the pre-tokenizer splits by SPLIT, and ids follow the merges.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True) and spec["normalizer"] is None
    unusual = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or unusual or model["type"] != "BPE":
        return None
    byte_of = {chr(b): b for b in PRINTED}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if token not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
    return ranks if in_order else None


class Encoder:
    """Ids of whole texts by the tokenizer, as little-endian 32-bit bytes.

    A vocabulary that can be read as ranks is applied by the faster library for these; texts that hold an added token
    or a very long run of white space, and other vocabularies, go to the tokenizer's own library.
    Both give the same ids.
    """

    def __init__(self, path: str, part: int = PART):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.part, self.fast = Tokenizer.from_file(path), part, None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if (ranks := ranks_of(path)) is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.added) or LONG_RUN.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that encode alone as they do together; without a place to cut, the rest is one."""
        at = 0
        while len(text) - at > self.part and (cut := CUT.search(text, at + self.part)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str) -> bytes:
        return self.ids(text) if len(text) <= self.part else b"".join(map(self.ids, self.parts(text)))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the pieces of each document; END_ID ends each one.

    Of a document that is too long the first piece takes what is left of whole ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows: list[tuple] = []
            for key, data in zip(b.column(0).to_pylist(), map(encoder(path).encode, b.column(1).to_pylist()), strict=True):
                data += END_ID.to_bytes(4, "little")
                n = len(data) // 4
                ends = range(n - (n - 1) // capacity * capacity, n + 1, capacity)
                for k, end in enumerate(ends):
                    start = max(0, end - capacity) if k else 0
                    part = data[4 * start : 4 * end]
                    rows.append((key, k, start, end - start, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (6 if with_ids else 5)
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return docs.select(id_col, text_or_empty(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{ids}")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset), by length and rank.

    Lengths come longest first. A piece goes to the open sequence with the least room that is enough; sequences with
    the same room are ranges, and a range takes as many pieces of a length at once as it has sequences.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    open_rooms, sequences, out = 0, 0, []

    def put(room: int, first: int, n: int) -> None:
        nonlocal open_rooms
        if room and n:
            rooms[room].append((first, n))
            open_rooms |= 1 << room

    for length in range(capacity, 0, -1):
        left, rank = counts.get(length, 0), 0
        while left and (fits := open_rooms >> length):
            room = length + (fits & -fits).bit_length() - 1
            first, n = rooms[room].pop()
            take = min(left, n)
            out.append((length, rank, take, first, capacity - room))
            put(room, first + take, n - take)
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            put(room - length, first, take)
            left, rank = left - take, rank + take
        each = capacity // length
        for per, n in ((each, left // each), (left % each, 1)):
            if per and n:
                out += [(length, rank + k * n, n, sequences, k * length) for k in range(per)]
                put(capacity - per * length, sequences, n)
                sequences, rank = sequences + n, rank + per * n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (a written table) with sequence_id and offset: places in as few sequences as best fit makes.

    At most `capacity` counts go to the driver, and the plan, which comes back as a broadcast, depends on these alone.
    Ranks within a length are by a hash of id and piece; repeated rows take a place each. No rows: none.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    hashed = pieces.withColumn("__h", F.xxhash64(F.col(id_col).cast("string"), "piece"))
    ranked = running_total(hashed, ["length"], "__h", [id_col, "piece"], F.lit(1).cast("long"), sum(counts.values()), "__rank")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = slots.value
        at = np.searchsorted((table[:, 0] << 44) + table[:, 1], (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        found = table[at]
        return pd.DataFrame({"sequence_id": found[:, 3] + rank.to_numpy() - found[:, 1], "offset": found[:, 4]})

    placed = ranked.withColumn("__slot", slot("length", "__rank"))
    return placed.select(*pieces.columns, F.col("__slot.sequence_id").alias("sequence_id"), F.col("__slot.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of `docs` with their places. Null texts count as empty and have the one id END_ID; null ids are kept.

    Columns of `docs` besides id and text have no effect; of equal rows each is packed.
    """
    return pack(written(pieces_of(docs, path, id_col, text_col, capacity, with_ids), "pieces"), id_col, capacity)


def sequences_of(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from pieces with ids; each is one row of CAPACITY ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def op2_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
