"""A pipeline from raw documents to packed training sequences, over operators of siltstone.llm.

Every stage takes all that the one before has kept. All but the last return the columns of documents; columns besides
doc_id, text, lang and source are carried along, whatever their names, unless these begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, language, mixing, packing, simhash
from siltstone.llm.common import id_remainder
from siltstone.sources.tables import settled, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus is labelled with.

    Profiles are learned from the rows that op8 learns from. Null texts, texts without a letter and texts far from all
    profiles go; without a labelled row all texts with a letter stay. Repeated rows are judged one by one. No rows: none.
    """
    learned = docs.where(F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(False)))
    return language.accepted(docs, language.learn_profiles(learned))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; null texts count as empty, null ids as the smallest.

    Of rows that are equal in id and text one stays. No rows: none.
    """
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id, and all rows with that id in the group.

    Texts without words have fingerprint 0 and are near each other; null ids come last. No rows: none.
    """
    return simhash.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in no order, since packing reads none.

    Null texts and texts without words have size 0; null sources are one source. Rows equal in all columns are taken
    together as often as the mix takes them; rows with the same id alone are different documents. No rows: none.
    """
    return mixing.taken_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts have the end token alone; each copy of a document is packed. No rows: none.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mix", mixed),
    ("pack", packed),
]

#: Tokenizers, fingerprints and profiles are not SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
