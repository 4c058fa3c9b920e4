"""Lexicon joins and sentiment scores.

A lexicon is a caller-supplied ``DataFrame`` (``word`` plus ``value`` or
``sentiment``).  Tokens are counted first (partial counts in the tokenising
stage) and the counts are joined: a frequent word reaches the join as one row
per group or document, also when the lexicon is too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sign_label
from .freq import count_by, top_n
from .reshape import natural_join


def label_tokens(tokens: DataFrame, lexicon: DataFrame, how: str = "inner") -> DataFrame:
    """Tokens joined with a lexicon on their shared columns (a word with
    several labels gives several rows)."""
    return natural_join(tokens, lexicon, how)


def label_counts(tokens: DataFrame, lexicon: DataFrame, group: list[str]) -> DataFrame:
    """``(group…, word, sentiment, n)``: labelled token counts (a lexicon row
    that is listed twice counts twice)."""
    counts = count_by(tokens, *group, "word")
    listed = count_by(lexicon.select("word", "sentiment"), "word", "sentiment", name="_listed")
    return label_tokens(counts, listed).select(*group, "word", "sentiment",
                                               (F.col("n") * F.col("_listed")).alias("n"))


def vocabulary_by_label(tokens: DataFrame, lexicon: DataFrame, group: list[str]) -> DataFrame:
    """Distinct words per group joined to the lexicon, counted per label
    (the number of *words*, not tokens, that carry each label)."""
    words = tokens.select(*group, "word").distinct()
    return count_by(label_tokens(words, lexicon), *group, "sentiment")


def doc_scores(tokens: DataFrame, values: DataFrame, doc: str, rating: str | None = None,
               extra: list[str] | None = None) -> DataFrame:
    """Per document: ``sentiment = sum(value)`` over its lexicon words and,
    when given, ``mean_rating = mean(rating)`` over the same matched tokens.
    Documents without a lexicon word have no row."""
    keys = [doc, *(extra or [])]
    counts = count_by(tokens, *keys, *([rating] if rating else []), "word")
    j = counts.join(values.select("word", "value"), "word")
    n = F.col("n")
    aggs = [F.sum(n * F.col("value")).alias("sentiment")]
    if rating:
        r = F.col(rating)
        aggs.insert(0, F.try_divide(F.sum(n * r).cast("double"), F.sum(F.when(r.isNotNull(), n)))
                    .alias("mean_rating"))
    return j.groupBy(*keys).agg(*aggs)


def words_of_negative(tokens: DataFrame, values: DataFrame, doc: str, group: list[str]) -> DataFrame:
    """``(group…, word, n)`` over the documents whose summed lexicon value is
    below zero.

    Texts are tokenised once: counts per (document, word) carry their value,
    and the document's score is a window over its own distinct words."""
    counts = count_by(tokens, doc, *group, "word")
    scores = values.groupBy("word").agg(F.sum("value").alias("_value"))
    scored = counts.join(scores, "word", "left").withColumn(
        "_score", F.sum(F.col("n") * F.col("_value")).over(Window.partitionBy(doc)))
    return scored.where("_score < 0").groupBy(*group, "word").agg(F.sum("n").alias("n"))


def negated_contributions(bigrams: DataFrame, heads: list[str], values: DataFrame,
                          k: int = 20) -> DataFrame:
    """Words following a head word (``not``), their lexicon value, count,
    ``contribution = n * value`` and sign; top ``k`` by |contribution| per head."""
    v = count_by(values.select(F.col("word").alias("word2"), "value"), "word2", "value", name="_listed")
    counted = count_by(bigrams.where(F.col("word1").isin(heads)), "word1", "word2").join(v, "word2")
    counted = counted.select("word1", "word2", "value", (F.col("n") * F.col("_listed")).alias("n"))
    scored = (counted.withColumn("contribution", F.col("n") * F.col("value"))
              .withColumn("sign", sign_label("value")))
    return top_n(scored, k, F.abs(F.col("contribution")), group=["word1"])
