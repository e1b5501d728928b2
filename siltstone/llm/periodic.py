"""Runs of repeated words, found by string synchronising sets at dyadic scales.

A run is a maximal stretch of words with a smallest period q that it holds EXPONENT times at least. For each scale t, a
power of two, a hash selects positions: i is selected if the least hash of the t-word windows that begin in [i, i + t] is
the one at i or at i + t, windows of a period up to t / 4 left aside. The choice depends on the 2t words from i on alone,
and any t neighbouring positions hold a selected one, unless the words there have a period up to t / 4.

So a run of a period q from t to 2t - 1 has a selected position i among its first t; i + q is selected as well, has the
same 2t words before it, and is the next position that does, as a nearer one would give the run a smaller period. Pairs
of neighbours with equal contexts thus propose the periods of the scale; each is then extended over the words themselves.
Periods under LEAST_SCALE, which no scale has, come from the highly periodic regions, found by comparing each word with
the one q before. They, and what smaller scales have found, are the windows that a scale leaves aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import text_or_empty, words_of

#: A run holds its period so often, and has so many words; the selection above needs an exponent of 4 or more.
EXPONENT, LEAST_WORDS = 4, 6
#: The smallest scale; shorter periods are looked for directly.
LEAST_SCALE = 4
#: Documents are worked on together up to so many words; a longer one alone.
TOGETHER = 1 << 17

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of windows of 2t words from those of t."""
    return _mixed(h[:-t] * np.uint64(0x9E3779B97F4A7C15) + h[t:]) if len(h) > t else h[:0]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h, done = np.minimum(h[:-step], h[step:]), done + step
    return h


def _stretches(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """[start, end) of the maximal stretches of `least` words at least in which words q apart are equal."""
    differ = np.concatenate([[-1], np.flatnonzero(ids[q:] != ids[:-q]), [len(ids) - q]])
    long = np.flatnonzero(np.diff(differ) - 1 >= least - q)
    return [(int(differ[k]) + 1, int(differ[k + 1]) + q) for k in long]


def _has_period(ids: np.ndarray, start: int, end: int, q: int) -> bool:
    return bool((ids[start : end - q] == ids[start + q : end]).all())


def _primitive(ids: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether q is the smallest period; one that is smaller divides it, in so long a stretch."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if _has_period(ids, start, end, q // p):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements are equal from the first on."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def _selected_pairs(h: np.ndarray, contexts: np.ndarray, aside: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, d): selected positions whose next selected one with an equal context comes d later, d from t to 2t - 1."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    own = np.where(aside, none, h)
    least = _least(own, t + 1)
    i = np.flatnonzero((least != none) & ((least == own[:-t]) | (least == own[t:])))
    i = i[np.argsort(contexts[i], kind="stable")]
    d = np.diff(i)
    pairs = np.flatnonzero((contexts[i[1:]] == contexts[i[:-1]]) & (d >= t) & (d < 2 * t))
    return i[pairs], d[pairs]


def find_runs(ids: np.ndarray, lengths: np.ndarray, exponent: int = EXPONENT, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in `ids`: texts of `lengths` numbers each, a number that comes once before and after each."""
    if exponent < 4:
        raise ValueError("scales find runs of an exponent of 4 or more")
    found, small = [], []
    for q in range(1, LEAST_SCALE):
        for start, end in _stretches(ids, q, 4 * q):
            if _primitive(ids, start, end, q):
                small.append((start, end, q))
    found += small
    at, h, own, t = np.arange(len(ids)), _mixed(ids.astype(np.uint64)), np.repeat(np.append(lengths, 0), np.append(lengths + 1, 1)), 1
    while t < LEAST_SCALE:
        h, t = _joined(h, t), 2 * t
    while (long := own >= exponent * t).any():
        if long.mean() < 0.7:  # shorter texts have no period of this scale or a larger one
            at, own, h = at[long], own[long], h[long[: len(h)]]
        contexts = _joined(h, t)
        if not len(contexts):
            break
        change = np.zeros(len(h) + 1, np.int64)
        for start, end, q in found:
            if 4 * q <= t <= end - start:
                a, b = np.searchsorted(at, (start, end - t + 1))
                change[min(a, len(h))] += 1
                change[min(b, len(h))] -= 1
        new, past = [], {}
        for i, d in sorted(zip(*(x.tolist() for x in _selected_pairs(h, contexts, np.cumsum(change[:-1]) > 0, t)), strict=True), key=lambda p: (p[1], p[0])):
            i = int(at[i])
            if i < past.get(d, 0):
                continue
            end = i + d + _equal_run(ids[i:], ids[i + d :])
            start = i - _equal_run(ids[:i][::-1], ids[d : i + d][::-1])
            past[d] = end - d
            if end - start >= max(least_words, exponent * d) and _primitive(ids, start, end, d):
                new.append((start, end, d))
        found += new
        h, t = contexts, 2 * t
    return sorted(r for r in set(found) if r[1] - r[0] >= max(least_words, exponent * r[2]))


def _of_texts(texts: list[list[bytes]], exponent: int, least_words: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """For each text, as words: its runs (start, length, period), and its words without repeats, joined."""
    lengths = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(lengths + 1) - lengths  # a separator comes before each text, and one after the last
    words = [w for t in texts for w in t]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.arange(len(number), len(number) + len(words) + len(texts) + 1, dtype=np.int64)
    of_word = np.repeat(firsts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(words))
    ids[of_word] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    gone: dict[int, np.ndarray] = {}
    for start, end, q in find_runs(ids, lengths, exponent, least_words):
        k = int(np.searchsorted(firsts, start, "right")) - 1
        start, end = start - int(firsts[k]), end - int(firsts[k])
        runs[k].append((start, end - start, q))
        gone.setdefault(k, np.zeros(len(texts[k]), bool))[start + q : end] = True
    return runs, [b" ".join(t if k not in gone else [t[i] for i in np.flatnonzero(~gone[k])]) for k, t in enumerate(texts)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of `docs`: __id, n (words), runs (by start, then period) and collapsed.

    `runs` has every run of `least_words` words at least whose period it holds `exponent` times (4 or more), by word
    numbers from 0; runs of different periods may overlap. `collapsed` is the text's words joined by one space without
    those that a run has after its first period. Null texts, empty ones and ones without words have no runs and collapse
    to an empty text; null ids and repeated rows are worked on like others. No rows: none.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
        ids, texts, size = [], [], 0
        for b in batches:
            for k in range(len(b)):
                words = b.column(1)[k].as_py().split()
                if texts and size + len(words) > TOGETHER:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(b.column(0)[k])
                texts.append(words)
                size += len(words)
        if texts:
            yield ids, texts

    kind = docs.schema[id_col].dataType
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in groups(batches):
            runs, left = _of_texts(texts, exponent, least_words)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            columns = [pa.array([x.as_py() for x in ids], ids[0].type), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, run_type), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "n", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("__id"), F.encode(text_or_empty(text_col), "utf-8").alias("t"))
    return rows.mapInArrow(run, f"__id {kind.simpleString()}, n bigint, runs {RUNS}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, then the least start, then the least period; null if there is none."""

    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x != y, F.when(x > y, -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)

    return F.get(F.array_sort(runs, order), F.lit(0))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a loop at the end of about every tenth text, as the contract of op13 has it.

    Of an unsigned h = crc32(doc_id as text) that 10 divides, with g = h / 10: from word a = g % n on, the text repeats
    its p = 1 + (n - a) / (3 + g % 8) words from a. Null ids have no loop.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text_or_empty("text").alias("text"), F.floor(h / 10).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("loops"))
    rows = rows.withColumn("w", F.when(F.col("loops"), words_of(F.col("text"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(0).cast("int"))
    rest = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (F.lit(1) + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    loop = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(loop, F.lit(1), rest))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(text, " ")).otherwise(F.col("text")).alias("text"))


def op13_query(docs: DataFrame) -> DataFrame:
    out = periodic_runs(looped(docs.select("doc_id", "text"))).withColumn("top", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return out.select(
        F.col("__id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n",
    )
