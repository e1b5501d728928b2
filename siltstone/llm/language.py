"""Language by rank-order profiles: a text's most frequent n-grams against those of each language.

A profile is the list of the PROFILE most frequent n-grams of one to three characters inside words, word ends marked.
The distance of a text is the sum over its own profile of how far each n-gram's rank is out of place, PROFILE where
the language's profile lacks it; the nearest language is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm.common import id_remainder, slices, text_or_empty

PROFILE = 300
LONGEST = 3
#: Profiles are learned from so many labelled documents at most, those with the least hashes of their ids.
SAMPLE_ROWS = 20_000
UNKNOWN = "und"
#: A text is taken to be in its nearest language if its score is this at least.
LEAST_SCORE = 0.2
#: Stands for the end of a word in an n-gram.
MARK = ord("_")
#: An n-gram is a number: its code points, of so many bits, from the highest bits on. So numbers are ordered as the strings are.
BITS = 21
#: Characters of a text whose n-grams are counted at once.
BLOCK = 1 << 18

Profiles = dict[str, dict[str, int]]


@lru_cache(1)
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter (Unicode category L)."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def marked_words(text: str) -> np.ndarray:
    """Code points of the words of a text, in lower case, with one mark before, between and after them."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    # of a run of other characters the first becomes the mark
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    words = np.where(letter, codes, MARK)[kept].astype(np.int64)
    if not len(words):
        return words
    ends = [MARK] if words[-1] != MARK else []
    return np.concatenate([[MARK], words, ends]).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams of one to LONGEST characters inside the words of a text, ascending, and how often each comes."""
    words = marked_words(text)
    keys, counts = [], []
    for at in range(0, len(words), BLOCK):
        part = words[at : at + BLOCK + LONGEST - 1]
        first, second, third = part[: min(BLOCK, len(part))], part[1 : BLOCK + 1], part[2 : BLOCK + 2]
        high = first << 2 * BITS
        pairs = high[: len(second)] | second << BITS
        # a mark in the middle is the end of one word and the beginning of the next
        triples = (pairs[: len(third)] | third)[second[: len(third)] != MARK]
        k, n = np.unique(np.concatenate([high[first != MARK], pairs, triples]), return_counts=True)
        keys.append(k)
        counts.append(n)
    return merged(keys, counts)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of several counts of n-grams."""
    if len(keys) == 1:
        return keys[0], counts[0]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total, at = np.unique(np.concatenate(keys), return_inverse=True)
    return total, np.bincount(at, np.concatenate(counts), len(total)).astype(np.int64)


def number_of(gram: str) -> int:
    return sum(ord(c) << (LONGEST - 1 - i) * BITS for i, c in enumerate(gram))


def gram_of(number: int) -> str:
    codes = [number >> (LONGEST - 1 - i) * BITS & (1 << BITS) - 1 for i in range(LONGEST)]
    return "".join(chr(c) for c in codes if c)


class Nearest:
    """Compares texts with profiles; holds the ranks of the profiles' n-grams, and nothing of the texts."""

    def __init__(self, profiles: Profiles, size: int = PROFILE):
        self.size, self.languages = size, sorted(profiles)
        ranks = {lang: {number_of(g): r for g, r in profiles[lang].items()} for lang in self.languages}
        self.known = np.array(sorted(set().union(*ranks.values())), np.int64)
        self.ranks = np.array([[ranks[lang].get(k, -1) for k in self.known.tolist()] for lang in self.languages], np.int64).reshape(len(self.languages), len(self.known))

    def profile(self, text: str) -> np.ndarray:
        """The most frequent n-grams; of equal ones the first by code points."""
        keys, n = gram_counts(text)
        return keys[np.argsort(-n, kind="stable")[: self.size]]

    def nearest(self, text: str) -> tuple[str, float]:
        """(language, score): score is 1 less the part of the greatest distance; ties go to the first name."""
        own = self.profile(text)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        far = np.full((len(self.languages), len(own)), self.size)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
            ranks = np.where(self.known[at] == own, self.ranks[:, at], -1)
            far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))))
        total = far.sum(axis=1)
        best = int(total.argmin())
        return self.languages[best], float(1 - total[best] / (self.size * len(own)))


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, rows: int = SAMPLE_ROWS) -> Profiles:
    """Ranks of each language's profile, from `rows` of `docs` at most.

    Rows without a language, id or text have no part. What comes to the driver is `size` n-grams for each language.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = usable.select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(rows)
    sample = usable.join(F.broadcast(ids), usable[id_col] == ids["__id"], "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            of_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of_lang.setdefault(lang, []).append(gram_counts(text))
            for lang, found in of_lang.items():
                keys, n = merged(*map(list, zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([gram_of(k) for k in keys.tolist()], pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    kept = counts.withColumn("rank", rank).where(F.col("rank") < size).collect()
    out: Profiles = {}
    for r in kept:
        out.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    return out


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1). Null texts and texts without a letter: `und`, 0.

    Every row is judged alone, by the whole of its text; no rows: none; columns with the names of added ones are
    replaced. Without profiles all are `und`.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Nearest(profiles, size)
        for texts in batches:
            yield pd.DataFrame([own.nearest(t) for t in texts], columns=["lang_pred", "score"])

    found = docs.withColumn("__found", predict(text_or_empty(text_col)))
    return found.withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")


def accepted(docs: DataFrame, profiles: Profiles, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` in a known language: nearest to one, with a score of `least` at least.

    Texts that are null or have no letter are rejected. Without profiles nothing else is. Each row is judged alone and
    comes out with all its columns, repeated rows as often; no rows: none.
    """
    found = identify(docs.select(F.struct("*").alias("__doc"), F.col(text_col).alias("__text")), profiles, "__text")
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    return found.where(known if profiles else F.col("__text").rlike(r"\p{L}")).select("__doc.*")


def op8_query(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)))
    profiles = learn_profiles(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")
