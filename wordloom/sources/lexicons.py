"""Word lists and lexicons.

Lexicons (afinn-, bing-, nrc-shaped tables) are third-party data; callers
pass their own ``DataFrame``.  For the bundled tests and queries a lexicon is
*derived* from the tokens of the ``benchmark`` table by a fixed arithmetic rule,
which runs identically in Spark and in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.reshape import bind_rows

# The default English stop-word list shipped with Spark ML
# (``StopWordsRemover.loadDefaultStopWords("english")``), 181 words, in its
# own order.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't "
    "didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's "
    "how's let's ought that's there's what's when's where's who's why's would"
).split()

# Emotion labels of an nrc-shaped lexicon, in the order used by
# the derivation rule below.
EMOTIONS = ["anger", "anticipation", "fear", "negative", "positive", "sadness", "trust"]


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def word_table(spark: SparkSession, words: list[str], lexicon: str) -> DataFrame:
    """A literal ``(word, lexicon)`` table.

    Built as SQL ``VALUES`` so it is a local relation whose exact size the
    planner knows (it is broadcast in joins); a parallelised RDD would have no
    size and force a shuffle of the other side.
    """
    rows = ", ".join(f"({_sql_str(w)}, {_sql_str(lexicon)})" for w in words)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(word, lexicon)")


def stop_words(spark: SparkSession, lexicon: str = "spark") -> DataFrame:
    """Stop-word table ``(word, lexicon)``."""
    return word_table(spark, STOP_WORDS, lexicon)


def with_custom_words(spark: SparkSession, words: list[str], base: DataFrame | None = None,
                      lexicon: str = "custom") -> DataFrame:
    """Custom words (lexicon ``custom``) appended to a stop-word table."""
    custom = word_table(spark, words, lexicon)
    base = base if base is not None else stop_words(spark)
    return bind_rows(custom, base)


def benchmark_vocabulary(benchmark: DataFrame) -> DataFrame:
    """Distinct tokens of a text table: the base of the derived lexicons."""
    return benchmark.select(F.explode(tokens("text")).alias("word")).distinct()


def _score(word):
    return (F.length(word) * 7 + F.ascii(word)) % 11 - 5


def afinn_like(vocab: DataFrame) -> DataFrame:
    """``(word, value)``: value = (len*7 + ascii) % 11 - 5, zero rows dropped."""
    return (vocab.select("word", _score(F.col("word")).cast("int").alias("value"))
            .where(F.col("value") != 0))


def bing_like(vocab: DataFrame) -> DataFrame:
    """``(word, sentiment)``: positive when the afinn-like value is > 0."""
    return afinn_like(vocab).select(
        "word", F.when(F.col("value") > 0, "positive").otherwise("negative").alias("sentiment"))


def nrc_like(vocab: DataFrame) -> DataFrame:
    """``(word, sentiment)``: up to two emotions per word, duplicates removed."""
    emo = F.array(*[F.lit(e) for e in EMOTIONS])
    a = F.element_at(emo, (F.length("word") % 7 + 1).cast("int"))
    b = F.element_at(emo, (F.ascii("word") % 7 + 1).cast("int"))
    return vocab.select("word", F.explode(F.array_distinct(F.array(a, b))).alias("sentiment"))
