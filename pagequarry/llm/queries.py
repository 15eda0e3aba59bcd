"""Queries of the text operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import (
    bpe,
    chat,
    jaccard,
    langid,
    lexical,
    packing,
    quality,
    secrets,
    spelling,
    substrings,
    topk,
    toxicity,
    urlrules,
)
from pagequarry.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the rule that rejected a text, which hangs on measured times."""
    return quality.quality_counts(table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), control_ids=True)


def op4_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), urlrules.rules_frame(spark))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are left out, so that the digest has one value a column."""
    return substrings.removed_words(table(spark, sf_dir, "documents")).drop("repeats")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(chat.with_control_strings(spark, table(spark, sf_dir, "conversations")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(table(spark, sf_dir, "documents"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version of every document, scanned into a ledger that starts empty."""
    return secrets.document_secrets(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_language_id,
        op3_packing,
        op4_top_products,
        op5_byte_bpe,
        op6_toxicity,
        op7_url_filters,
        op8_substring_dedup,
        op9_chat_formatting,
        op10_jaccard_join,
        op11_secret_scans,
        op12_lexical_search,
        op13_spelling_variants,
    )
}
