"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, where an operator's contract counts words: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same class for functions that take characters, not patterns.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch that are worked on at once; Spark bounds the batch itself by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
SLICE_ROWS = 200


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order; null or blank: an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo m: how the contracts fold documents."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


def slices(batches: Iterable[pa.RecordBatch] | Iterable[pa.Array]) -> Iterator:
    """Batches or arrays in slices of SLICE_ROWS rows, so that few texts at once are Python objects."""
    for b in batches:
        for at in range(0, len(b), SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)
