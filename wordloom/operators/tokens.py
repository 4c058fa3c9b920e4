"""Tokens, n-grams and stop-word removal.

All row-local: tokenising and n-gram building are a ``Generate`` over the
text row (no shuffle, no window).  Stop-word removal is a left-anti join
against a word list; the planner broadcasts it from its measured size (the
bundled list has 181 words), so the token side never shuffles for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import boundary_tokens, tokens


def unnest_tokens(df: DataFrame, text_col: str = "text", out: str = "word",
                  position: str | None = None, boundaries: bool = False) -> DataFrame:
    """One row per token; the text column is dropped, the others kept.

    ``position`` (optional) names a 0-based token position column;
    ``boundaries`` cuts by the Unicode word boundary rules.  Documents without
    tokens give no rows.
    """
    keep = [c for c in df.columns if c != text_col]
    toks = boundary_tokens(text_col) if boundaries else tokens(text_col)
    if position:
        return df.select(*keep, F.posexplode(toks).alias(position, out))
    return df.select(*keep, F.explode(toks).alias(out))


def unnest_ngrams(df: DataFrame, n: int, text_col: str = "text", prefix: str = "word",
                  joined: str | None = None) -> DataFrame:
    """Overlapping word n-grams as columns ``word1..wordn``.

    Built inside the row: the token array is zipped with its shifted slices,
    so no shuffle or window is needed.  A text with fewer than ``n`` tokens
    yields one row of nulls.  ``joined`` (optional) adds the n-gram as one
    space-separated string (null for the null row).
    """
    keep = [c for c in df.columns if c != text_col]
    staged = df.select(*keep, tokens(text_col).alias("_tok"))
    cnt = F.greatest(F.size("_tok") - (n - 1), F.lit(0))
    parts = [F.slice("_tok", F.lit(i + 1), cnt).alias(f"{prefix}{i + 1}") for i in range(n)]
    grams = staged.select(*keep, F.explode_outer(F.arrays_zip(*parts)).alias("_g"))
    names = [f"{prefix}{i + 1}" for i in range(n)]
    out = grams.select(*keep, *[F.col("_g").getField(nm).alias(nm) for nm in names])
    if joined:
        out = out.withColumn(joined, F.when(F.col(names[0]).isNotNull(),
                                            F.concat_ws(" ", *[F.col(c) for c in names])))
    return out


def anti_join_words(df: DataFrame, words: DataFrame, on: str = "word") -> DataFrame:
    """Drop rows whose ``on`` is in ``words``; a null ``on`` is kept."""
    sw = words.select(F.col("word").alias("_sw")).distinct()
    return df.join(sw, df[on] == sw["_sw"], "left_anti")


def remove_stop_words(df: DataFrame, stop: DataFrame | list[str],
                      cols: list[str] | None = None) -> DataFrame:
    """Drop rows where any of ``cols`` (default ``word``) is a stop word; a
    null word never matches, so such rows survive.

    ``stop`` is a word table (anti join per column) or a literal word list,
    which becomes a hash-set filter inside the scan stage (no join at all).
    """
    for c in cols or ["word"]:
        if isinstance(stop, DataFrame):
            df = anti_join_words(df, stop, on=c)
        else:
            df = df.where(F.col(c).isNull() | ~F.col(c).isin(list(stop)))
    return df
