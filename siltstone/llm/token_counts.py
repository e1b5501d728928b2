"""Token counts, with overlap resynchronisation for huge documents.

A huge text is encoded in overlapping chunks, with the places of the tokens. Where two chunks overlap they are spliced
at a place that is a boundary of both and is proven stable: no piece of the vocabulary holds a space mark after another
character, so no token of any text crosses the place before a space that follows another character. An overlap without
such a place is widened, up to the whole of the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import slices, text_or_empty

LIMIT = 4096
#: Characters of a chunk, and of the overlap that is tried first. Longer texts are huge.
CHUNK, OVERLAP = 32_768, 256
MARK = "▁"

Begins = Callable[[str], np.ndarray | None]


@lru_cache(1)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(1)
def splits_at_spaces(path: str) -> bool:
    """Whether no piece has a space mark after another character."""
    model = processor(path)
    return not any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))


@lru_cache(1)
def piece_chars(path: str) -> np.ndarray:
    """Characters of each piece; of the bytes of a character the first has it."""
    model = processor(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return np.array([int(int(p[3:5], 16) & 0xC0 != 0x80) if model.is_byte(i) else len(p) for i, p in enumerate(pieces)], np.int64)


def begins(path: str, text: str) -> np.ndarray | None:
    """Where the tokens of a text begin, in characters; the mark that the library puts first begins at 0.

    All bytes of a character begin where it does. None where the pieces are not the text, as under a model that changes
    characters or where the text has a mark of its own.
    """
    model = processor(path)
    ids = model.encode(text)
    if model.decode(ids) != text:
        return None
    sizes = piece_chars(path)[np.array(ids, np.int64)]
    ends = np.cumsum(sizes)
    return np.maximum(0, ends - np.maximum(sizes, 1) - 1) if (ends[-1] if len(ends) else 1) == len(text) + 1 else None


def stable(text: str, places: np.ndarray) -> np.ndarray:
    """Of places inside the text, those before a space and after another character."""
    return np.array([p for p in places.tolist() if text[p] == " " and text[p - 1] not in (" ", MARK)], np.int64)


def count_spliced(text: str, encode: Begins, chunk: int = CHUNK, overlap: int = OVERLAP) -> int | None:
    """The number of tokens of a text, of which `chunk` characters and a widened overlap are encoded at a time.

    None where `encode` has no places for a chunk: such a text is to be encoded whole.
    """

    def tokens(start: int, end: int, spliced: bool) -> np.ndarray | None:
        # after a splice the library's own mark stands for the space there, which is left out
        at = encode(text[start + spliced : end])
        return None if at is None else np.where(at > 0, at + start + spliced, start)

    total, start, end, width = 0, 0, min(len(text), chunk), overlap
    now = tokens(start, end, False)
    while now is not None and end < len(text):
        back = max(start, end - width)
        if back > start:
            later = min(len(text), back + max(chunk, 2 * width))
            then = tokens(back, later, False)
            if then is None:
                return None
            common = np.intersect1d(now, then)
            places = stable(text, common[(common > back) & (common < end)])
            if len(places):
                at = int(places[-1])
                total += int((now < at).sum())
                now, start, end, width = then[then >= at], at, later, overlap
            else:
                width *= 2
        else:  # no place for a splice in all of the chunk
            end = min(len(text), end + max(chunk, end - start))
            now, width = tokens(start, end, start > 0), overlap
    return None if now is None else total + len(now)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, out: str = "n_tokens") -> DataFrame:
    """`docs` with `out`: tokens of the text as the library counts them, null 0.

    Every row is counted alone; no rows: none; a column named `out` is replaced. Where the vocabulary has pieces across
    spaces, or pieces are not the text, huge texts are encoded whole.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, size = processor(path), chunk if splits_at_spaces(path) else 1 << 62

        def huge(t: str) -> int:
            n = count_spliced(t, lambda s: begins(path, s), size, overlap)
            return len(model.encode(t)) if n is None else n

        for texts in batches:
            out: list[int] = []
            for part in slices([texts]):
                values = [t or "" for t in part.to_pylist()]
                short = [t for t in values if len(t) <= size]
                counts = iter([len(ids) for ids in model.encode(short, num_threads=1)] if short else [])
                out += [next(counts) if len(t) <= size else huge(t) for t in values]
            yield pa.array(out, pa.int64())

    return docs.withColumn(out, F.arrow_udf(run, "bigint")(text_or_empty(text_col)))


def op6_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    size = F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes")
    return counted.select("doc_id", size, "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
