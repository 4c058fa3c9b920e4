"""A corpus pipeline: every stage works on what its predecessor kept.

``run(spark, sf_dir)`` applies ``STAGES`` to the table of documents; each
stage's rows are written as Parquet in the shared folder and read again as the
next one's documents.  All stages but the last return the columns of
documents; texts that a stage changes get their new ``n_chars``.  As a stage
is only called with a written table, it first removes the intermediate tables
that the stage before it wrote (and no others).

SQL cannot express the n-gram join, the tagger and the packing, so there is no
``ORACLE_SQL``; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import jaccard_join, line_dedup, packing, pii, quality_rules
from wordloom.llm.scratch import gathering, quoted, remove, table_path, unused, written
from wordloom.sources.tables import read_table


def _recounted(df: DataFrame) -> DataFrame:
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


#: intermediate tables of the latest call of each stage, by folder and stage
_tables: dict[tuple[str, str], list[str]] = {}


def _stage(after: str | None):
    """A stage gathers its intermediate tables; the next one, which is called
    with the written rows, removes them."""
    def deco(fn):
        @functools.wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for path in _tables.pop((sf_dir, after), []):
                remove(spark, path)
            with gathering([]) as paths:
                out = fn(spark, docs, sf_dir)
            _tables[sf_dir, fn.__name__] = paths
            return out
        return run_stage
    return deco


@_stage(after=None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their domain's verdict."""
    others = [c for c in docs.columns if c != "text"]
    (row,) = unused(docs, "row")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias(row), "source", "text")
    rated = quality_rules.rate_documents(rows)
    return rated.where("kept").select(*[F.col(c) if c == "text" else F.col(f"{row}.{quoted(c)}")
                                        for c in docs.columns])


@_stage(after="quality")
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line."""
    return _recounted(line_dedup.dedup_documents(docs))


@_stage(after="lines")
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs)


@_stage(after="near_copies")
def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked."""
    return _recounted(pii.mask_documents(docs))


@_stage(after="privacy")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_copies),
          ("pii", privacy), ("packing", pack)]

#: SQL cannot express the stages from the n-gram join on
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = table_path(spark, f"stage-{name}")
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
