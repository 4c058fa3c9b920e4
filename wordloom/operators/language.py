"""Language identification by character n-gram profiles (Cavnar & Trenkle).

A profile is the ``top`` most frequent character 1..3-grams of a text (or of
all texts of a language), each token padded with ``_`` on both sides, ranked
1, 2, ... by count (ties by gram).  A text is assigned the language whose
profile is closest by the out-of-place distance: the sum over the text's
grams of |rank in text - rank in language|, a gram missing from the language
profile costing ``top``.

Scale: grams are taken from *distinct tokens per text weighted by their
count*, never by sliding over the raw text.  The profile of a language is a top-k
(per-partition group limit before the shuffle).  The profile of a text is cut and
ranked in numpy from its token counts, one row a text, so neither a row a gram
nor a sort of all grams is needed.  Classifying joins text
grams with language profiles on the gram (the profile table is bounded by
languages x ``top`` rows) and never pairs texts with languages directly: a
language with no shared gram has the worst possible distance, so it can
only matter when no language shares a gram (then the language is null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.text import tokens
from .freq import held

# Profile length and the longest character n-gram.
TOP = 400
MAX_N = 3


def token_counts(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(key…, w, c)``: distinct tokens per text with their count."""
    return (df.select(*key, F.explode(tokens(text)).alias("w"))
            .groupBy(*key, "w").agg(F.count(F.lit(1)).alias("c")))


def char_grams(counted: DataFrame, key: list[str], max_n: int = MAX_N) -> DataFrame:
    """``(key…, gram, cnt)`` from ``(key…, w, c)``: 1..max_n-grams of ``_w_``.

    Positions are exploded with ``sequence`` and grams cut with ``substr``
    (built-ins kept in generated code; no lambda functions)."""
    p = F.concat(F.lit("_"), F.col("w"), F.lit("_"))
    pos = counted.select(*key, "c", p.alias("_p"), F.explode(F.sequence(F.lit(1), F.length(p))).alias("_i"))
    cut = [F.when(F.col("_i") <= F.length("_p") - (n - 1), F.col("_p").substr(F.col("_i"), F.lit(n)))
           for n in range(1, max_n + 1)]
    return (pos.select(*key, "c", F.explode(F.array(*cut)).alias("gram"))
            .where(F.col("gram").isNotNull())
            .groupBy(*key, "gram").agg(F.sum("c").alias("cnt")))


def ranked(grams: DataFrame, key: list[str], top: int = TOP, rank: str = "r",
           with_size: str | None = None) -> DataFrame:
    """Top ``top`` grams per key, ranked 1.. by count desc then gram (the
    rank filter becomes a per-partition group limit before the shuffle).
    ``with_size`` adds the number of kept grams per key (same partitioning,
    no extra shuffle)."""
    w = Window.partitionBy(*key).orderBy(F.desc("cnt"), F.asc("gram"))
    out = grams.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= top).drop("cnt")
    if with_size:
        out = out.withColumn(with_size, F.max(rank).over(Window.partitionBy(*key)))
    return out


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP) -> DataFrame:
    """Language profiles ``(lang, gram, pr)`` from texts with a known language."""
    counted = token_counts(labelled.where(F.col(lang).isNotNull()), [lang], text)
    return ranked(char_grams(counted, [lang]), [lang], top, "pr")


def train_counted(counted: DataFrame, lang: str = "lang", top: int = TOP) -> DataFrame:
    """``train`` from token counts per text, ``(key…, lang, w, c)``."""
    per_lang = counted.groupBy(F.col(lang).alias("lang"), "w").agg(F.sum("c").alias("c"))
    per_lang = per_lang.select(held("lang", "c"), "w", "c").where(F.col("lang").isNotNull())
    return ranked(char_grams(per_lang, ["lang"]), ["lang"], top, "pr")


def text_grams(df: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """``(key…, gram, cnt)`` for every text."""
    keys = [key] if isinstance(key, str) else list(key)
    return char_grams(token_counts(df, keys, text), keys)


#: texts whose profiles are given out at once
TEXTS_AT_ONCE = 256


def _ranked_grams(words: pa.Array, counts: np.ndarray, sizes: np.ndarray, top: int, max_n: int) -> list[np.ndarray]:
    """The ``top`` grams of each text, most frequent first, ties by gram; a text has
    the next ``sizes`` words.  A gram is a number of 21 bits a character, short ones
    with zeros behind, so numbers are ordered as grams are."""
    padded = pc.binary_join_element_wise("_", words, "_", "")
    point = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    length = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(point))  # characters of the word from here on
    weight = np.repeat(counts, length).astype(np.float64)
    codes, code = [], np.zeros(len(point), np.int64)
    for n in range(max_n):
        code = code.copy()
        code[:len(point) - n] |= point[n:] << (21 * (2 - n))
        codes.append(code)
    ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(sizes)))]
    out = []
    for lo, hi in zip(ends[:-1], ends[1:]):
        whole = [left[lo:hi] > n for n in range(max_n)]
        gram, at = np.unique(np.concatenate([c[lo:hi][w] for c, w in zip(codes, whole)]), return_inverse=True)
        total = np.bincount(at, np.concatenate([weight[lo:hi][w] for w in whole]), len(gram))
        best = gram[np.argsort(-total, kind="stable")[:top]]
        points = np.stack([best >> 42, (best >> 21) & 0x1FFFFF, best & 0x1FFFFF], axis=1).astype(np.uint32)
        out.append(np.ascontiguousarray(points).view("<U3").ravel())
    return out


def text_profiles(counted: DataFrame, key: str | list[str], top: int = TOP, max_n: int = MAX_N) -> DataFrame:
    """``(key…, gram, r, _n)`` from token counts ``(key…, w, c)``: the ``top`` grams
    (of 3 characters at most) of every text with their ranks, and their number."""
    if not 1 <= max_n <= 3:
        raise ValueError("grams have 1 to 3 characters")
    keys = [key] if isinstance(key, str) else list(key)
    packed = (counted.groupBy(*keys).agg(F.collect_list(F.struct("w", "c")).alias("_v"))
              .select(*keys, F.col("_v.w").alias("_w"), F.col("_v.c").alias("_c")))

    def profiles(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(lo, TEXTS_AT_ONCE)
                sizes = pc.list_value_length(batch.column("_w")).to_numpy(zero_copy_only=False)
                counts = batch.column("_c").flatten().to_numpy(zero_copy_only=False)
                grams = _ranked_grams(batch.column("_w").flatten(), counts, sizes, top, max_n)
                offsets = pa.array(np.cumsum([0, *map(len, grams)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(grams), pa.string()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], lists], names=[*keys, "_g"])

    schema = StructType([packed.schema[k] for k in keys]).add("_g", ArrayType(StringType()))
    return (packed.mapInArrow(profiles, schema)
            .select(*keys, F.size("_g").alias("_n"), F.posexplode("_g").alias("_at", "gram"))
            .select(*keys, "gram", (F.col("_at") + 1).alias("r"), "_n"))


def classify(df: DataFrame, profiles: DataFrame, key: str | list[str], text: str = "text",
             lang: str = "lang", top: int = TOP, out: str = "predicted") -> DataFrame:
    """``(key, out)``: the closest language for every text that has tokens.

    ``df`` holds texts (``key``, ``text``), their token counts (``key``, ``w``,
    ``c``) or their grams (``key``, ``gram``, ``cnt``) from ``text_grams``.

    One pass: text grams are left-joined to the profiles on the gram; per
    (text, language) the matched grams give sum|r - pr| and the unmatched
    ones cost ``top`` each; grams matching no language form a null-language
    group that ranks last, so a text sharing no gram with any profile gets a
    null language.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if "gram" in df.columns:
        doc = ranked(df.select(*keys, "gram", "cnt"), keys, top, "r", with_size="_n")
    else:
        doc = text_profiles(df if "w" in df.columns else token_counts(df, keys, text), keys, top)
    # profiles have ``top`` rows a language at most; were they joined by a shuffle, all
    # grams of all texts would move, and a common gram's to one task
    scored = (doc.join(F.broadcast(profiles), "gram", "left")
              .groupBy(*keys, lang).agg(F.sum(F.abs(F.col("r") - F.col("pr"))).alias("_s"),
                                      F.count("pr").alias("_k"), F.max("_n").alias("_n"))
              .withColumn("distance", F.col("_s") + F.lit(top) * (F.col("_n") - F.col("_k"))))
    w = Window.partitionBy(*keys).orderBy(F.col(lang).isNull(), F.asc("distance"), F.asc(lang))
    best = scored.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1)
    return best.select(*keys, F.col(lang).alias(out))
