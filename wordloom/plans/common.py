"""Shared inputs of the registered queries and the matching SQL fragments.

Every query reads the driver tables at ``sf_dir``; the fixture parameters
(group column, language, thresholds, derived lexicons) stand in for the
reference's own data, which is not shipped with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN
from ..operators.tokens import remove_stop_words, unnest_tokens
from ..sources import lexicons
from ..sources.tables import read_table, spread

# Fixture parameters (see README): group column, language, custom words.
GROUP = "source"
LANG = "en"
CUSTOM_WORDS = ["ing", "tion", "ed"]


def documents(spark: SparkSession, sf_dir: str, lang: str | None = LANG,
              cols: tuple[str, ...] = ("doc_id", GROUP, "text"),
              deal: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of the documents of a language, dealt out by ``deal``."""
    d = read_table(spark, sf_dir, "documents")
    if lang:
        d = d.where(F.col("lang") == lang)
    return spread(d.select(*cols), *deal)


def stop() -> list[str]:
    """The stop-word list (a fixed list: filtered as a hash set, no join)."""
    return list(lexicons.STOP_WORDS)


def rated_documents(spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    """English documents with their rating (``labels.quality``), joined per
    document before tokenising, so no token-level join is needed later."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents(spark, sf_dir).join(lab, "doc_id", how)


def tidy(docs: DataFrame, custom: bool = False) -> DataFrame:
    """Tokens of a document table without stop words (and custom words)."""
    toks = remove_stop_words(unnest_tokens(docs), stop())
    if custom:
        toks = remove_stop_words(toks, CUSTOM_WORDS)
    return toks


def tidy_tokens(spark: SparkSession, sf_dir: str, lang: str | None = LANG,
                custom: bool = False) -> DataFrame:
    """English tokens without stop words: ``(doc_id, source, word)``."""
    return tidy(documents(spark, sf_dir, lang), custom)


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.benchmark_vocabulary(read_table(spark, sf_dir, "benchmark"))


def afinn(spark, sf_dir):
    return lexicons.afinn_like(vocab(spark, sf_dir))


def bing(spark, sf_dir):
    return lexicons.bing_like(vocab(spark, sf_dir))


def nrc(spark, sf_dir):
    return lexicons.nrc_like(vocab(spark, sf_dir))


# ---------------------------------------------------------------- SQL side
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


P = q(TOKEN_PATTERN)
STOP_LIST = "[" + ", ".join(q(w) for w in lexicons.STOP_WORDS) + "]"
CUSTOM_LIST = "[" + ", ".join(q(w) for w in CUSTOM_WORDS) + "]"
EMO_LIST = "[" + ", ".join(q(w) for w in lexicons.EMOTIONS) + "]"

SQL_BASE = f"""
stop AS (SELECT unnest({STOP_LIST}) AS word),
custom AS (SELECT unnest({CUSTOM_LIST}) AS word),
d AS (SELECT doc_id, {GROUP}, text FROM documents WHERE lang = '{LANG}'),
tok AS (SELECT doc_id, {GROUP}, unnest(regexp_extract_all(lower(text), {P})) AS word FROM d),
tidy AS (SELECT * FROM tok WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = tok.word)),
tidyc AS (SELECT * FROM tidy WHERE NOT EXISTS (SELECT 1 FROM custom s WHERE s.word = tidy.word)),
vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {P})) AS word FROM benchmark),
afinn AS (SELECT word, CAST((length(word) * 7 + ascii(word)) % 11 - 5 AS INTEGER) AS value
          FROM vocab WHERE (length(word) * 7 + ascii(word)) % 11 - 5 <> 0),
bing AS (SELECT word, CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END AS sentiment FROM afinn),
nrc AS (SELECT DISTINCT word, sentiment FROM (
          SELECT word, {EMO_LIST}[length(word) % 7 + 1] AS sentiment FROM vocab
          UNION ALL
          SELECT word, {EMO_LIST}[ascii(word) % 7 + 1] AS sentiment FROM vocab))
"""


def with_base(select: str, ctes: str = "") -> str:
    """A query over the shared CTEs plus its own (unused CTEs cost nothing)."""
    extra = ",\n" + ctes.strip().rstrip(",") if ctes.strip() else ""
    return "WITH " + SQL_BASE.strip() + extra + "\n" + select.strip()
