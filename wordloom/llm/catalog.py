"""One registered query for each operator of the subpackage, over whole tables,
with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (chat_format, jaccard_join, lexical_search, line_dedup, packing, pii, quality_rules,
               sentencepiece_codec, spelling, substring_dedup, token_counts, topk_search, url_filter)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose id is divisible by 50."""
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the library's segmentation, decoded back."""
    return sentencepiece_codec.encode_documents(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the lines of every document that repeat an earlier line."""
    return line_dedup.judged_documents(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text and its longest prefix within 4096 tokens."""
    return token_counts.count_documents(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page: the longest rule, else the list of hosts."""
    return url_filter.judge_pages(read_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of every text and the verdict of its domain."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.rate_documents(docs, drop_text=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as read back from its formatted text."""
    rows = chat_format.with_hostile_conversation(read_table(spark, sf_dir, "conversations"))
    return chat_format.conversation_digests(chat_format.format_turns(rows))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text."""
    return pii.find_documents(read_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of copies, links and group of every document."""
    return jaccard_join.join_documents(read_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a repeated window of 35 words, and the rest's digest."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_documents(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word."""
    return spelling.variant_groups(spelling.word_counts(read_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_url_filters": op5_url_filters,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_pii": op9_pii,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE = {
    "op8_chat_formatting": chat_format.ORACLE,
    "op1_topk_search": topk_search.ORACLE,
    "op5_url_filters": url_filter.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_substring_dedup": substring_dedup.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
