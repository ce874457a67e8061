"""From raw documents to packed sequences, in five stages.

Each stage is one operator of ``tideline.llm`` applied to all that the stage
before it kept.  ``run`` chains them; a caller that writes each result and
reads it again gets the same rows.

All stages take an empty table and give one.  All but the last return the rows
they keep with all their columns, whatever the names of those; rows that repeat
stay or go together; other columns than doc_id, text and lang decide nothing.
Very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import read
from tideline.llm.decontaminate import without_leaks
from tideline.llm.language import for_learning, learn, with_known_language
from tideline.llm.near_dedup import without_near_duplicates
from tideline.llm.packing import pack_documents
from tideline.llm.quality import kept_documents

TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024
#: Near-duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep.

    Null, empty and short texts go.  A null lang is a stratum of its own; a
    null doc_id has no label and is judged by its text.
    """
    return kept_documents(docs, read(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language.

    Null and empty texts go.  Rows with a null doc_id or lang are not learnt
    from but judged like all others; without labels nothing is known and all go.
    """
    return with_known_language(docs, learn(for_learning(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id.

    Null and empty texts are in no group and stay; a null doc_id is never the
    least, so its row goes if its group has a document with an id.
    """
    return without_near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark.

    Null and empty texts hold none and stay; null and empty items match none.
    """
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences.

    Null text counts as empty: one piece that holds the end's id.  A null
    doc_id stays null; repeated rows are packed each.
    """
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID, CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the learnt stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
