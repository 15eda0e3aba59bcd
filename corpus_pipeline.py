"""A training corpus from documents: language, quality, near copies, repeated passages, packing.

Each stage works on all rows that the one before it kept. Stages before the last return the columns of the
documents; the last returns the pieces of the packed windows.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagequarry.llm import jaccard, langid, packing, quality, substrings  # noqa: E402
from pagequarry.llm.common import stored, table  # noqa: E402
from pagequarry.llm.queries import vocabulary  # noqa: E402


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; NULL texts, texts without a letter and narrow margins go."""
    return langid.keep_identified(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; NULL and empty texts go, repeated rows are judged each for itself."""
    return quality.keep_good(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and a similarity of 0.8."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand earlier; one of which nothing is left goes, a NULL text stays."""
    return substrings.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens; repeated rows are packed each for itself, an empty table gives no rows."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), control_ids=True)


STAGES = [
    ("language", clear_language),
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("packing", packed),
]

#: Not expressible in SQL: trained language dictionaries, tokenizer, windows that depend on the partitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
