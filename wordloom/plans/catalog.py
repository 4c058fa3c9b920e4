"""Registered queries: one per inventory id, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
A query without an ``ORACLE`` entry is checked by row count plus unit tests.
Doubles that are compared are rounded (``R`` digits) in both engines; ranks
on doubles use the rounded value so last-bit differences cannot move ties.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..functions.text import (NOT_A_WORD, boundary_pattern, extract_word, log10_axis, percent_label, recode, round_half_even,
                              separate, unite, url_id)
from ..operators import freq, graph, language, reshape, sentiment, stats, topics
from ..operators.pairwise import (never_together, pairwise_cor, pairwise_cor_above, pairwise_cor_anchored,
                                  pairwise_cor_full)
from ..operators.tokens import anti_join_words, remove_stop_words, unnest_ngrams, unnest_tokens
from ..sources.lexicons import STOP_WORDS, with_custom_words
from ..session import shared_path
from ..sources.tables import (corpus_item, flatten, lines, numbered, read_csv, read_table, spread, write_csv,
                              written_nested)
from .common import (CUSTOM_WORDS, GROUP, P, afinn, bing, documents, nrc, rated_documents, stop, tidy,
                     tidy_tokens, with_base)

R = 9  # digits kept when doubles are compared

# Fixed values from the reference's queries (sizes, limits, seed):
TOP_WORDS = 15         # top words per group, positive/negative words per group
TOP_EMOTION = 10       # words per emotion
TOP_NEGATIVE_DOC = 10  # words of negative documents
TOP_TFIDF = 10         # tf-idf words per group
TOP_BIGRAMS = 10       # bigrams per (group, rating)
TOP_NEGATED = 20       # words after the head word, by |contribution|
TOP_CORRELATED = 10    # partners per anchor word
SHARE_LIMIT = 0.0009   # axis limit of the term-share histogram
HIST_BINS = 30         # bins of the term-share histogram
LDA_K, LDA_SEED = 2, 123

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def fill_sql(sql: str) -> str:
    return sql.replace("{P}", P)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = fill_sql(sql)
        return fn
    return deco


# ------------------------------------------------------------------ C4
@register("c4_top_words", with_base(f"""
SELECT source, word, n FROM (SELECT source, word, count(*) AS n FROM tidy GROUP BY source, word)
QUALIFY rank() OVER (PARTITION BY source ORDER BY n DESC) <= {TOP_WORDS}
"""))
def c4_top_words(spark, sf_dir):
    """Top words per group, stop words removed, ties kept."""
    counts = freq.count_by(tidy_tokens(spark, sf_dir), GROUP, "word")
    return freq.top_n(counts, TOP_WORDS, "n", group=[GROUP])


# ------------------------------------------------------------------ C21
@register("c21_word_count", with_base("""
SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), {P})) AS word FROM documents) t
WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = t.word)
GROUP BY word
"""))
def c21_word_count(spark, sf_dir):
    """Word counts of a whole text table (all languages), stop words removed."""
    toks = remove_stop_words(unnest_tokens(documents(spark, sf_dir, lang=None,
                                                     cols=("doc_id", "text"))), stop())
    return freq.count_by(toks, "word", sort=True)


# ------------------------------------------------------------------ C9 / A4
@register("c9_group_word_counts", with_base("""
SELECT source, word, count(*) AS n FROM tidy GROUP BY source, word
"""))
def c9_group_word_counts(spark, sf_dir):
    """Word counts per group (``count(group, word)``)."""
    return freq.count_by(tidy_tokens(spark, sf_dir), GROUP, "word")


# ------------------------------------------------------------------ X1
def sql_boundary_pattern() -> str:
    """The boundary pattern for an engine without class subtraction."""
    def ranges(wanted):
        out: list[list[int]] = []
        for c in filter(wanted, range(0x110000)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)

    def inside(c, *tables):
        return any(a <= c <= b for t in tables for a, b in t)

    letters = {c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl")}
    return boundary_pattern(
        ranges(lambda c: c in letters and not inside(c, text_functions.KATAKANA, text_functions.UNSPACED)),
        ranges(lambda c: c in letters and inside(c, text_functions.UNSPACED)),
        ranges(lambda c: unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf")
               and c != text_functions.ZERO_WIDTH_SPACE))


@register("x1_boundary_words", rf"""
SELECT source, word, count(*) AS n FROM (
  SELECT source, unnest(regexp_extract_all(lower(text), '{sql_boundary_pattern()}')) AS word FROM documents)
WHERE NOT regexp_matches(word, '{NOT_A_WORD}') GROUP BY ALL
""")
def x1_boundary_words(spark, sf_dir):
    """Word counts per group of all languages, words cut by the Unicode boundary rules."""
    toks = unnest_tokens(documents(spark, sf_dir, lang=None), boundaries=True)
    return freq.count_by(toks, GROUP, "word")


# ------------------------------------------------------------------ C10
@register("c10_frequent_words", with_base("""
SELECT source, word, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n, word) AS INTEGER) AS ord
FROM (SELECT source, word, count(*) AS n FROM tidyc GROUP BY source, word) WHERE n > 50
"""))
def c10_frequent_words(spark, sf_dir):
    """Words above a count threshold per group, with their display order
    (custom stop words removed as well)."""
    counts = freq.count_by(tidy_tokens(spark, sf_dir, custom=True), GROUP, "word")
    return freq.order_column_wide(counts.where(F.col("n") > 50), "n", "word", group=[GROUP])


# ------------------------------------------------------------------ C7 / A11 / W8
_TFIDF_SQL = """
cnt AS (SELECT source, word, count(*) AS n FROM tidy GROUP BY source, word),
tot AS (SELECT source, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY source),
dfq AS (SELECT word, count(*) AS dfreq FROM cnt GROUP BY word),
tfidf AS (
  SELECT c.source, c.word, c.n, t.total,
         round(CAST(c.n AS DOUBLE) / t.total, 9) AS tf,
         round(ln(CAST((SELECT count(DISTINCT source) FROM cnt) AS DOUBLE) / d.dfreq), 9) AS idf,
         round((CAST(c.n AS DOUBLE) / t.total) *
               ln(CAST((SELECT count(DISTINCT source) FROM cnt) AS DOUBLE) / d.dfreq), 9) AS tf_idf
  FROM cnt c JOIN tot t USING (source) JOIN dfq d USING (word))
"""


def _tfidf(spark, sf_dir):
    counts = freq.count_by(tidy_tokens(spark, sf_dir), GROUP, "word")
    out = stats.tf_idf(counts, "word", GROUP, total="total")
    return out.select(GROUP, "word", "n", "total", *[F.round(c, R).alias(c) for c in ("tf", "idf", "tf_idf")])


@register("a11_tf_idf", with_base("SELECT * FROM tfidf", _TFIDF_SQL))
def a11_tf_idf(spark, sf_dir):
    """TF-IDF of every (group, word): group totals attached, tf, idf, tf_idf."""
    return _tfidf(spark, sf_dir)


@register("c7_tf_idf_top", with_base(
    "SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY tf_idf, word) AS INTEGER) AS ord FROM ("
    f"SELECT * FROM tfidf QUALIFY rank() OVER (PARTITION BY source ORDER BY tf_idf DESC) <= {TOP_TFIDF})",
    _TFIDF_SQL))
def c7_tf_idf_top(spark, sf_dir):
    """Highest tf-idf words per group (ties kept), with their display order."""
    top = freq.top_n(_tfidf(spark, sf_dir), TOP_TFIDF, "tf_idf", group=[GROUP])
    return freq.order_column(top, "tf_idf", "word", group=[GROUP])


# ------------------------------------------------------------------ C8 / A12
@register("c8_term_share_hist", with_base(f"""
SELECT source, CAST(least(floor((share - 0.0) * {HIST_BINS} / {SHARE_LIMIT}), {HIST_BINS - 1}) AS INTEGER) AS bin,
       count(*) AS n
FROM (SELECT c.source, CAST(c.n AS DOUBLE) / t.total AS share
      FROM (SELECT source, word, count(*) AS n FROM tidy GROUP BY source, word) c
      JOIN (SELECT source, count(*) AS total FROM tidy GROUP BY source) t USING (source))
WHERE share <= {SHARE_LIMIT}
GROUP BY ALL
"""))
def c8_term_share_hist(spark, sf_dir):
    """Histogram (equal bins up to an axis limit) of term shares ``n/total`` per group."""
    counts = freq.with_totals(freq.count_by(tidy_tokens(spark, sf_dir), GROUP, "word"), [GROUP])
    share = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    return freq.histogram(counts, share, [GROUP], hi=SHARE_LIMIT, bins=HIST_BINS).drop("bin_lo")


# ------------------------------------------------------------------ C5 (bing)
@register("c5_sentiment_words", with_base(f"""
SELECT source, word, sentiment, n FROM (
  SELECT source, word, sentiment, count(*) AS n FROM tidy JOIN bing USING (word)
  GROUP BY source, word, sentiment)
QUALIFY rank() OVER (PARTITION BY source, sentiment ORDER BY n DESC) <= {TOP_WORDS}
"""))
def c5_sentiment_words(spark, sf_dir):
    """Top positive and negative words per group (bing-shaped lexicon)."""
    counts = sentiment.label_counts(tidy_tokens(spark, sf_dir), bing(spark, sf_dir), [GROUP])
    return freq.top_n(counts, TOP_WORDS, "n", group=[GROUP, "sentiment"])


# ------------------------------------------------------------------ C11 / A7
@register("c11_emotion_vocabulary", with_base("""
SELECT source, sentiment, count(*) AS n
FROM (SELECT DISTINCT source, word FROM tidyc) w JOIN nrc USING (word)
GROUP BY source, sentiment
"""))
def c11_emotion_vocabulary(spark, sf_dir):
    """Number of distinct words per emotion and group (nrc-shaped lexicon)."""
    return sentiment.vocabulary_by_label(tidy_tokens(spark, sf_dir, custom=True),
                                         nrc(spark, sf_dir), [GROUP])


# ------------------------------------------------------------------ C12 / W6
# The emotions that are shown.
EMO_KEEP = ["positive", "negative", "trust", "fear", "anticipation", "sadness"]


@register("c12_emotion_top_words", with_base(f"""
SELECT *, CAST(dense_rank() OVER (PARTITION BY source ORDER BY n, word) AS INTEGER) AS ord FROM (
  SELECT source, word, sentiment, n FROM (
    SELECT source, word, sentiment, count(*) AS n FROM tidyc JOIN nrc USING (word)
    GROUP BY source, word, sentiment)
  WHERE sentiment IN ({", ".join("'" + e + "'" for e in EMO_KEEP)})
  QUALIFY rank() OVER (PARTITION BY source, sentiment ORDER BY n DESC) <= {TOP_EMOTION})
"""))
def c12_emotion_top_words(spark, sf_dir):
    """Most frequent words per emotion and group, with the words' display order."""
    counts = sentiment.label_counts(tidy_tokens(spark, sf_dir, custom=True), nrc(spark, sf_dir), [GROUP])
    top = freq.top_n(counts.where(F.col("sentiment").isin(EMO_KEEP)), TOP_EMOTION, "n",
                     group=[GROUP, "sentiment"])
    # one position per word across its emotions (a word's count is the same in each)
    return freq.order_column(top, "n", "word", group=[GROUP], dense=True)


# ------------------------------------------------------------------ C13 / A6 / J4
_SCORES_SQL = """
lab AS (SELECT doc_id, quality FROM labels),
scores AS (
  SELECT doc_id, source, avg(quality) AS mean_rating, CAST(sum(value) AS BIGINT) AS sentiment
  FROM tidyc JOIN afinn USING (word) LEFT JOIN lab USING (doc_id)
  GROUP BY doc_id, source)
"""


def _tidy_rated(spark, sf_dir):
    return tidy(rated_documents(spark, sf_dir), custom=True)


def _scores(spark, sf_dir):
    return sentiment.doc_scores(_tidy_rated(spark, sf_dir), afinn(spark, sf_dir), "doc_id",
                                rating="quality", extra=[GROUP])


@register("c13_doc_sentiment", with_base(
    "SELECT doc_id, source, round(mean_rating, 9) AS mean_rating, sentiment FROM scores", _SCORES_SQL))
def c13_doc_sentiment(spark, sf_dir):
    """Per document: summed lexicon value and mean rating of matched tokens."""
    return _scores(spark, sf_dir).withColumn("mean_rating", F.round("mean_rating", R))


# ------------------------------------------------------------------ C14 / J5
@register("c14_negative_doc_words", with_base(f"""
SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n, word) AS INTEGER) AS ord FROM (
SELECT source, word, n FROM (
  SELECT t.source, t.word, count(*) AS n
  FROM tidyc t JOIN scores s USING (doc_id) WHERE s.sentiment < 0 GROUP BY t.source, t.word)
QUALIFY rank() OVER (PARTITION BY source ORDER BY n DESC) <= {TOP_NEGATIVE_DOC})
""", _SCORES_SQL))
def c14_negative_doc_words(spark, sf_dir):
    """Top 10 words per group in documents whose score is negative."""
    counts = sentiment.words_of_negative(tidy_tokens(spark, sf_dir, custom=True), afinn(spark, sf_dir),
                                         "doc_id", [GROUP])
    top = freq.top_n(counts, TOP_NEGATIVE_DOC, "n", group=[GROUP])
    return freq.order_column(top, "n", "word", group=[GROUP])


# ------------------------------------------------------------------ n-grams
_NGRAM_SQL = """
tk AS (SELECT doc_id, source, regexp_extract_all(lower(text), {P}) AS t FROM d),
bi AS (
  SELECT doc_id, source, z[1] AS word1, z[2] AS word2 FROM (
    SELECT doc_id, source, unnest(list_zip(t[1:len(t)-1], t[2:len(t)])) AS z FROM tk WHERE len(t) >= 2)
  UNION ALL SELECT doc_id, source, NULL, NULL FROM tk WHERE len(t) < 2),
quad AS (
  SELECT doc_id, source, z[1] AS word1, z[2] AS word2, z[3] AS word3, z[4] AS word4 FROM (
    SELECT doc_id, source,
           unnest(list_zip(t[1:len(t)-3], t[2:len(t)-2], t[3:len(t)-1], t[4:len(t)])) AS z
    FROM tk WHERE len(t) >= 4)
  UNION ALL SELECT doc_id, source, NULL, NULL, NULL, NULL FROM tk WHERE len(t) < 4),
bif AS (SELECT * FROM bi
        WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = bi.word1)
          AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = bi.word2))
"""


def _bigrams(spark, sf_dir, joined=None):
    return unnest_ngrams(documents(spark, sf_dir), 2, joined=joined)


@register("c15_bigram_counts", with_base("""
SELECT source, CASE WHEN word1 IS NULL THEN NULL ELSE word1 || ' ' || word2 END AS bigram, count(*) AS n
FROM bi GROUP BY ALL
""", _NGRAM_SQL))
def c15_bigram_counts(spark, sf_dir):
    """Raw bigram counts per group (short texts give one null bigram)."""
    grams = _bigrams(spark, sf_dir, joined="bigram").select(GROUP, "bigram")
    return freq.count_by(grams, GROUP, "bigram")


@register("c15_bigram_counts_filtered", with_base("""
SELECT source, word1, word2, count(*) AS n FROM bif GROUP BY ALL
""", _NGRAM_SQL))
def c15_bigram_counts_filtered(spark, sf_dir):
    """Bigram counts per group with neither word a stop word."""
    grams = remove_stop_words(_bigrams(spark, sf_dir), stop(), ["word1", "word2"])
    return freq.count_by(grams, GROUP, "word1", "word2")


@register("c17_fourgram_counts", with_base("""
SELECT source, word1, word2, word3, word4, count(*) AS n FROM quad
WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = quad.word1)
  AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = quad.word2)
  AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = quad.word3)
  AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = quad.word4)
GROUP BY ALL
""", _NGRAM_SQL))
def c17_fourgram_counts(spark, sf_dir):
    """4-gram counts per group with no stop word in any position."""
    grams = unnest_ngrams(documents(spark, sf_dir), 4)
    grams = remove_stop_words(grams, stop(), ["word1", "word2", "word3", "word4"])
    return freq.count_by(grams, GROUP, "word1", "word2", "word3", "word4")


@register("c16_bigrams_by_rating", with_base(f"""
SELECT *, CAST(row_number() OVER (PARTITION BY source, rating ORDER BY n, word) AS INTEGER) AS ord FROM (
  SELECT source, rating, word, n FROM (
    SELECT source, l.quality AS rating,
           coalesce(word1, 'NA') || ' ' || coalesce(word2, 'NA') AS word, count(*) AS n
    FROM bif JOIN labels l USING (doc_id) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY source, rating ORDER BY n DESC, word) <= {TOP_BIGRAMS})
""", _NGRAM_SQL))
def c16_bigrams_by_rating(spark, sf_dir):
    """Most frequent stop-word-free bigrams per (group, rating), ties cut by
    the bigram text, with their display order inside the (group, rating) facet."""
    docs = rated_documents(spark, sf_dir, how="inner").withColumnRenamed("quality", "rating")
    grams = remove_stop_words(unnest_ngrams(docs, 2), stop(), ["word1", "word2"])
    grams = grams.select(GROUP, "rating", unite("word1", "word2", sep=" ").alias("word"))
    top = freq.top_n(freq.count_by(grams, GROUP, "rating", "word"), TOP_BIGRAMS, "n",
                     group=[GROUP, "rating"], ties=False)
    return freq.order_column(top, "n", "word", group=[GROUP, "rating"])


NEG_HEADS = ["the"]


@register("c6_negated_bigrams", with_base(f"""
SELECT *, CAST(row_number() OVER (PARTITION BY word1 ORDER BY contribution, word2) AS INTEGER) AS ord FROM (
  SELECT word1, word2, value, n, contribution, sign FROM (
    SELECT word1, word2, value, count(*) AS n, count(*) * value AS contribution,
           CASE WHEN value > 0 THEN 'positive' WHEN value <= 0 THEN 'negative' END AS sign
    FROM bi JOIN (SELECT word AS word2, value FROM afinn) a USING (word2)
    WHERE word1 IN ('the') GROUP BY word1, word2, value)
  QUALIFY rank() OVER (PARTITION BY word1 ORDER BY abs(contribution) DESC) <= {TOP_NEGATED})
""", _NGRAM_SQL))
def c6_negated_bigrams(spark, sf_dir):
    """Words after a head word, with lexicon value, count, contribution and
    sign; the strongest |contribution| per head word, with their display
    order by contribution within the head word (``ord``)."""
    top = sentiment.negated_contributions(_bigrams(spark, sf_dir), NEG_HEADS, afinn(spark, sf_dir),
                                          k=TOP_NEGATED)
    return freq.order_column(top, "contribution", "word2", group=["word1"])


# ------------------------------------------------------------------ C18 / M6 / M7
EDGE_MIN = 20
_EDGES_SQL = f"""
edges AS (SELECT source, word1 AS "from", word2 AS "to", count(*) AS n FROM (
  SELECT * FROM bi WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = bi.word1)
                     AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = bi.word2)) b
  GROUP BY ALL HAVING count(*) > {EDGE_MIN})
"""


def _edges(spark, sf_dir):
    grams = remove_stop_words(_bigrams(spark, sf_dir), stop(), ["word1", "word2"])
    counts = freq.count_by(grams, GROUP, "word1", "word2")
    return graph.graph_from_edges(counts.where(F.col("n") > EDGE_MIN), group=[GROUP])


@register("m6_graph_edges", with_base('SELECT source, "from", "to", n FROM edges', _NGRAM_SQL + "," + _EDGES_SQL))
def m6_graph_edges(spark, sf_dir):
    """Edges of each group's bigram graph (bigram counts above the cut)."""
    return _edges(spark, sf_dir)[0]


@register("m6_graph_vertices", with_base(
    'SELECT DISTINCT source, name FROM (SELECT source, "from" AS name FROM edges'
    ' UNION ALL SELECT source, "to" FROM edges)',
    _NGRAM_SQL + "," + _EDGES_SQL))
def m6_graph_vertices(spark, sf_dir):
    """Vertices of each group's bigram graph."""
    return _edges(spark, sf_dir)[1]


@register("m7_graph_degrees", with_base("""
SELECT source, name, coalesce(o.out_degree, 0) AS out_degree, coalesce(i.in_degree, 0) AS in_degree
FROM (SELECT source, "from" AS name, count(*) AS out_degree FROM edges GROUP BY ALL) o
FULL JOIN (SELECT source, "to" AS name, count(*) AS in_degree FROM edges GROUP BY ALL) i USING (source, name)
""", _NGRAM_SQL + "," + _EDGES_SQL))
def m7_graph_degrees(spark, sf_dir):
    """In/out degree of every vertex of each group's bigram graph."""
    return graph.degrees(_edges(spark, sf_dir)[0], [GROUP])


@register("m7_graph_summary", with_base("""
SELECT source, vertices, edges
FROM (SELECT source, count(DISTINCT name) AS vertices FROM (
        SELECT source, "from" AS name FROM edges UNION ALL SELECT source, "to" FROM edges) GROUP BY source) v
JOIN (SELECT source, count(*) AS edges FROM edges GROUP BY source) e USING (source)
""", _NGRAM_SQL + "," + _EDGES_SQL))
def m7_graph_summary(spark, sf_dir):
    """Vertex and edge count of each group's bigram graph."""
    return graph.summary(_edges(spark, sf_dir)[0], [GROUP])


# ------------------------------------------------------------------ C2 / C3 / A9 / O5 / O6 / W1 / P13
BENCH_GROUP = "src0"

_FREQ_SQL = f"""
ext AS (SELECT source AS author, nullif(regexp_extract(word, '([a-z'']+)', 1), '') AS word FROM tidyc),
cnt AS (SELECT author, word, count(*) AS n FROM ext GROUP BY ALL),
shares AS (SELECT author, word, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY author) AS proportion FROM cnt),
bench AS (SELECT word, proportion AS {BENCH_GROUP} FROM shares WHERE author = '{BENCH_GROUP}'),
other AS (SELECT word, author, proportion FROM shares WHERE author <> '{BENCH_GROUP}'),
authors AS (SELECT DISTINCT author FROM other),
frequency AS (
  SELECT o.word, b.{BENCH_GROUP}, o.author, o.proportion
  FROM other o LEFT JOIN bench b ON b.word IS NOT DISTINCT FROM o.word
  UNION ALL
  SELECT b.word, b.{BENCH_GROUP}, a.author, NULL FROM bench b CROSS JOIN authors a
  WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.author = a.author AND o.word IS NOT DISTINCT FROM b.word)),
pairs AS (SELECT * FROM frequency WHERE proportion IS NOT NULL AND {BENCH_GROUP} IS NOT NULL)
"""


def _shares(spark, sf_dir):
    """Share of each word in its group; all readers share one shuffle of counts."""
    toks = tidy_tokens(spark, sf_dir, custom=True).select(
        F.col(GROUP).alias("author"), extract_word("word").alias("word"))
    counts = freq.count_by(toks, "author", "word").select(freq.held("author"), "word", "n")
    return freq.share_within(counts, ["author"])


def paired_shares(spark, sf_dir):
    """Words with a share in both groups (the null word is a word): ``(word,
    author, proportion, <benchmark>)``; groups come from the data."""
    shares = _shares(spark, sf_dir).drop("n")
    bench = shares.where(F.col("author") == BENCH_GROUP).select(
        F.col("word").alias("bench_word"), F.col("proportion").alias(BENCH_GROUP))
    others = shares.where(F.col("author") != BENCH_GROUP)
    return others.join(bench, others["word"].eqNullSafe(bench["bench_word"])).drop("bench_word")


def frequency_table(spark, sf_dir):
    """The correlogram data: rows with at least one of the two shares (a row
    with neither holds nothing).

    A word's shares meet in one row, an entry a group; a word of the benchmark
    group is then listed for every other group."""
    shares = _shares(spark, sf_dir)
    # one entry a group; the count is read so that the shuffle of counts serves here too
    names = shares.select(F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.col("author"))))).scalar()
    entry = F.when(F.col("author") != BENCH_GROUP, F.struct("author", "proportion"))
    words = shares.groupBy("word").agg(F.max(F.when(F.col("author") == BENCH_GROUP, F.col("proportion"))).alias(BENCH_GROUP),
                                       F.map_from_entries(F.collect_list(entry)).alias("by"))
    groups = F.when(F.col(BENCH_GROUP).isNull(), F.map_keys("by")).otherwise(F.array_remove(names, BENCH_GROUP))
    return (words.select("word", BENCH_GROUP, "by", F.explode(groups).alias("author"))
            .select("word", BENCH_GROUP, "author", F.try_element_at("by", F.col("author")).alias("proportion")))


@register("c2_correlogram", with_base(f"""
SELECT word, round({BENCH_GROUP}, 9) AS {BENCH_GROUP}, author, round(proportion, 9) AS proportion,
       round(abs({BENCH_GROUP} - proportion), 9) AS deviation
FROM frequency
""", _FREQ_SQL))
def c2_correlogram(spark, sf_dir):
    """Correlogram table: per word the benchmark group's share against each
    other group's share, plus their absolute deviation."""
    f = frequency_table(spark, sf_dir)
    return f.select("word", F.round(BENCH_GROUP, R).alias(BENCH_GROUP), "author",
                    F.round("proportion", R).alias("proportion"),
                    F.round(F.abs(F.col(BENCH_GROUP) - F.col("proportion")), R).alias("deviation"))


_CORTEST_SQL = f"""
ct AS (SELECT author, corr(proportion, {BENCH_GROUP}) AS r,
              count(*) FILTER (WHERE proportion IS NOT NULL AND {BENCH_GROUP} IS NOT NULL) AS n
       FROM frequency GROUP BY author)
"""


@register("c3_cor_test", with_base("""
SELECT author, round(r, 9) AS estimate, n,
       round(r * sqrt(CAST(n AS DOUBLE) - 2) / sqrt(1.0 - r * r), 6) AS statistic, n - 2 AS df,
       round(tanh(atanh(r) - 1.959963984540054 / sqrt(CAST(n AS DOUBLE) - 3)), 9) AS conf_low,
       round(tanh(atanh(r) + 1.959963984540054 / sqrt(CAST(n AS DOUBLE) - 3)), 9) AS conf_high
FROM ct
""", _FREQ_SQL + "," + _CORTEST_SQL))
def c3_cor_test(spark, sf_dir):
    """Pearson test of each group's word shares against the benchmark group:
    r, complete pairs, t, df and the 95 % interval."""
    t = stats.cor_test(paired_shares(spark, sf_dir), "proportion", BENCH_GROUP, ["author"], p_value=False)
    return t.select("author", F.round("estimate", R).alias("estimate"), "n",
                    F.round("statistic", 6).alias("statistic"), "df",
                    F.round("conf_low", R).alias("conf_low"), F.round("conf_high", R).alias("conf_high"))


# Student's t with whole degrees of freedom is a finite series in the cosine of atan(t / sqrt(df))
@register("a9_cor_test_pvalue", with_base("""
SELECT author, round(r, 9) AS estimate, n, round(t, 6) AS statistic, df,
       abs(round(1 - CASE WHEN df % 2 = 0 THEN sin(th) * (SELECT coalesce(sum(exp(
             lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + 2 * k * ln(cos(th)))), 0)
           FROM range(0, df // 2) s(k))
         ELSE 2 / pi() * (th + sin(th) * (SELECT coalesce(sum(exp(
             lgamma(k + 1) - lgamma(k + 1.5) + 0.5 * ln(pi()) - ln(2) + (2 * k + 1) * ln(cos(th)))), 0)
           FROM range(0, (df - 1) // 2) s(k))) END, 9)) AS p_value
FROM (SELECT *, atan(abs(t) / sqrt(CAST(df AS DOUBLE))) AS th FROM (
  SELECT author, r, n, n - 2 AS df, r * sqrt(CAST(n AS DOUBLE) - 2) / sqrt(1.0 - r * r) AS t FROM ct))
""", _FREQ_SQL + "," + _CORTEST_SQL))
def a9_cor_test_pvalue(spark, sf_dir):
    """The same test with its two-sided p-value (t distribution; the p-value
    runs on the one aggregated row per group)."""
    t = stats.cor_test(paired_shares(spark, sf_dir), "proportion", BENCH_GROUP, ["author"])
    return t.select("author", F.round("estimate", R).alias("estimate"), "n",
                    F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", R).alias("p_value"))


# ------------------------------------------------------------------ C19 / M1 / M2 / F6 / J9
MIN_WORD_N = 100
ANCHORS = ["th", "er", "nd", "ha"]
ANCHORS_ITEM2 = ["re", "es"]

_PHI_SQL = f"""
tk2 AS (SELECT doc_id, nullif(regexp_extract(word, '([a-z'']+)', 1), '') AS word FROM tok),
fw AS (SELECT word FROM tk2 GROUP BY word HAVING count(*) >= {MIN_WORD_N}),
inc AS (SELECT DISTINCT word AS item, doc_id AS feature FROM tk2
        WHERE word IS NOT NULL AND word IN (SELECT word FROM fw WHERE word IS NOT NULL)),
marg AS (SELECT item, count(*) AS n FROM inc GROUP BY item),
nn AS (SELECT CAST(count(DISTINCT feature) AS DOUBLE) AS big_n FROM inc),
co AS (SELECT a.item AS item1, b.item AS item2, count(*) AS n11
       FROM inc a JOIN inc b USING (feature) WHERE a.item <> b.item GROUP BY ALL),
phi AS (
  SELECT m1.item AS item1, m2.item AS item2,
         CASE WHEN m1.n * (big_n - m1.n) * m2.n * (big_n - m2.n) > 0 THEN
           (big_n * coalesce(co.n11, 0) - CAST(m1.n AS DOUBLE) * m2.n)
           / sqrt((m1.n * (big_n - m1.n)) * (m2.n * (big_n - m2.n))) END AS correlation
  FROM marg m1 CROSS JOIN marg m2 CROSS JOIN nn
  LEFT JOIN co ON co.item1 = m1.item AND co.item2 = m2.item
  WHERE m1.item <> m2.item)
"""


def review_tokens(spark, sf_dir):
    """``(doc_id, salt, word)`` rows of English words (stop words kept, word clean-up
    applied); rare words are left in.

    The texts are dealt by document, those without an id by their text, so the words
    of a document are counted where they lie, and every branch of the query reads
    the texts that were dealt."""
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("salt")
    docs = documents(spark, sf_dir, cols=("doc_id", salt, "text"), deal=("doc_id", "salt"))
    return unnest_tokens(docs).select("doc_id", "salt", extract_word("word").alias("word"))


def review_words(spark, sf_dir):
    """``(doc_id, word)``: the list of the English words of each text, cleaned up
    as in ``review_tokens``; rare words are left in."""
    docs = documents(spark, sf_dir, cols=("doc_id", "text"), deal=("doc_id", "text"))
    return docs.select("doc_id", F.transform(text_functions.tokens("text"), extract_word).alias("word"))


@register("c19_pairwise_cor", with_base(
    "SELECT item1, item2, round(correlation, 9) AS correlation FROM phi JOIN co USING (item1, item2)", _PHI_SQL))
def c19_pairwise_cor(spark, sf_dir):
    """Phi correlation over documents of every ordered pair of frequent words
    that occur together."""
    out = pairwise_cor(review_tokens(spark, sf_dir), "word", "doc_id", MIN_WORD_N, "salt")
    return out.select("item1", "item2", F.round("correlation", R).alias("correlation"))


@register("a10_pairwise_cor_full", with_base(
    "SELECT item1, item2, round(correlation, 9) AS correlation FROM phi", _PHI_SQL))
def a10_pairwise_cor_full(spark, sf_dir):
    """Phi correlation of all ordered pairs of frequent words, those that never
    occur together included."""
    out = pairwise_cor_full(review_tokens(spark, sf_dir), "word", "doc_id", MIN_WORD_N, "salt")
    return out.select("item1", "item2", F.round("correlation", R).alias("correlation"))


@register("a10_never_together", with_base("""
SELECT n1, n2, count(*) AS pairs, round(any_value(correlation), 9) AS correlation FROM (
  SELECT m1.n AS n1, m2.n AS n2, phi.correlation FROM phi JOIN marg m1 ON m1.item = item1 JOIN marg m2 ON m2.item = item2
  WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.item1 = phi.item1 AND co.item2 = phi.item2)) GROUP BY n1, n2
""", _PHI_SQL))
def a10_never_together(spark, sf_dir):
    """The ordered pairs of frequent words that never occur together, in classes
    of equal document counts, with their correlation."""
    out = never_together(review_tokens(spark, sf_dir), "word", "doc_id", MIN_WORD_N, "salt")
    return out.select("n1", "n2", "pairs", F.round("correlation", R).alias("correlation"))


PHI_LEAST = 0.5


@register("a10_phi_above", with_base(
    f"SELECT item1, item2, round(correlation, 9) AS correlation FROM phi WHERE correlation >= {PHI_LEAST}", _PHI_SQL))
def a10_phi_above(spark, sf_dir):
    """Ordered pairs of frequent words with a phi correlation from the threshold up."""
    out = pairwise_cor_above(review_tokens(spark, sf_dir), "word", "doc_id", PHI_LEAST, MIN_WORD_N, "salt")
    return out.select("item1", "item2", F.round("correlation", R).alias("correlation"))


_IN_ANCH = ", ".join(f"'{a}'" for a in ANCHORS)
_IN_ANCH2 = ", ".join(f"'{a}'" for a in ANCHORS_ITEM2)


@register("m2_cor_anchor_top", with_base(f"""
SELECT *, CAST(row_number() OVER (PARTITION BY item1 ORDER BY correlation, item2) AS INTEGER) AS ord FROM (
SELECT item1, item2, round(correlation, 9) AS correlation FROM phi
WHERE item1 IN ({_IN_ANCH}) AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = phi.item2)
  AND correlation IS NOT NULL
QUALIFY rank() OVER (PARTITION BY item1 ORDER BY round(correlation, 9) DESC) <= {TOP_CORRELATED})
""", _PHI_SQL))
def m2_cor_anchor_top(spark, sf_dir):
    """Ten words most correlated with each anchor word (stop words excluded
    as partners)."""
    cors = pairwise_cor_anchored(review_words(spark, sf_dir), "word", "doc_id", ANCHORS, MIN_WORD_N)
    cors = remove_stop_words(cors.withColumn("correlation", F.round("correlation", R)),
                             stop(), ["item2"])
    top = freq.top_n(cors, TOP_CORRELATED, "correlation", group=["item1"])
    return freq.order_column(top, "correlation", "item2", group=["item1"])


@register("m2_cor_anchor_item2_top", with_base(f"""
SELECT *, CAST(row_number() OVER (PARTITION BY item2 ORDER BY correlation, item1) AS INTEGER) AS ord FROM (
SELECT item1, item2, round(correlation, 9) AS correlation FROM phi
WHERE item2 IN ({_IN_ANCH2}) AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.word = phi.item1)
  AND correlation IS NOT NULL
QUALIFY rank() OVER (PARTITION BY item2 ORDER BY round(correlation, 9) DESC) <= {TOP_CORRELATED})
""", _PHI_SQL))
def m2_cor_anchor_item2_top(spark, sf_dir):
    """Ten words most correlated with each anchor used as ``item2`` (phi is
    symmetric, so the anchored pairs are swapped)."""
    cors = pairwise_cor_anchored(review_words(spark, sf_dir), "word", "doc_id", ANCHORS_ITEM2, MIN_WORD_N)
    cors = cors.select(F.col("item2").alias("item1"), F.col("item1").alias("item2"),
                       F.round("correlation", R).alias("correlation"))
    cors = remove_stop_words(cors, stop(), ["item1"])
    top = freq.top_n(cors, TOP_CORRELATED, "correlation", group=["item2"])
    return freq.order_column(top, "correlation", "item1", group=["item2"])


_M2_ALL_SQL = """
tops AS (SELECT item1, item2, round(correlation, 9) AS correlation FROM phi
  WHERE {anchor} IN ({anchors}) AND correlation IS NOT NULL
  QUALIFY rank() OVER (PARTITION BY {anchor} ORDER BY round(correlation, 9) DESC) <= {k}),
pos AS (SELECT {other}, CAST(row_number() OVER (ORDER BY stat, {other}) AS INTEGER) AS ord FROM (
  SELECT {other}, round(avg(correlation), 9) AS stat FROM tops GROUP BY ALL))
"""


@register("m2_cor_anchor_top_all", with_base(
    "SELECT item1, item2, correlation, ord FROM tops JOIN pos USING (item2)",
    _PHI_SQL + "," + _M2_ALL_SQL.format(anchor="item1", other="item2", anchors=_IN_ANCH, k=TOP_CORRELATED)))
def m2_cor_anchor_top_all(spark, sf_dir):
    """Ten words most correlated with each anchor word, stop words included; a
    partner has one display position, by its mean correlation over the anchors."""
    cors = pairwise_cor_anchored(review_words(spark, sf_dir), "word", "doc_id", ANCHORS, MIN_WORD_N)
    top = freq.top_n(cors.withColumn("correlation", F.round("correlation", R)), TOP_CORRELATED,
                     "correlation", group=["item1"])
    return freq.order_by_stat(top, "correlation", "item2")


@register("m2_cor_anchor_item2_top_all", with_base(
    "SELECT item1, item2, correlation, ord FROM tops JOIN pos USING (item1)",
    _PHI_SQL + "," + _M2_ALL_SQL.format(anchor="item2", other="item1", anchors=_IN_ANCH2, k=TOP_CORRELATED)))
def m2_cor_anchor_item2_top_all(spark, sf_dir):
    """The same for anchors used as ``item2``."""
    cors = pairwise_cor_anchored(review_words(spark, sf_dir), "word", "doc_id", ANCHORS_ITEM2, MIN_WORD_N)
    cors = cors.select(F.col("item2").alias("item1"), F.col("item1").alias("item2"),
                       F.round("correlation", R).alias("correlation"))
    return freq.order_by_stat(freq.top_n(cors, TOP_CORRELATED, "correlation", group=["item2"]),
                              "correlation", "item1")


# ------------------------------------------------------------------ F4 / F6 with a count gate, O6, S2, S5, S13, W10
FREQUENT_GRAM = 3


@register("f6_gated_bigrams", with_base(f"""
SELECT source, word1, word2, count(*) AS n FROM bif GROUP BY ALL HAVING count(*) >= {FREQUENT_GRAM}
""", _NGRAM_SQL))
def f6_gated_bigrams(spark, sf_dir):
    """Stop-word-free bigrams with enough occurrences per group; rare ones are
    stopped by the count gate before the shuffle."""
    grams = remove_stop_words(_bigrams(spark, sf_dir), stop(), ["word1", "word2"])
    return freq.count_frequent(grams, GROUP, "word1", "word2", least=FREQUENT_GRAM)


@register("f4_frequent_fourgrams", with_base(f"""
SELECT source, word1, word2, word3, word4, count(*) AS n FROM quad WHERE word1 IS NOT NULL
GROUP BY ALL HAVING count(*) >= {FREQUENT_GRAM}
""", _NGRAM_SQL))
def f4_frequent_fourgrams(spark, sf_dir):
    """4-grams with enough occurrences per group, pruned by their bigrams."""
    grams = unnest_ngrams(documents(spark, sf_dir), 4).where("word1 is not null")
    return freq.frequent_ngrams(grams, [GROUP], ["word1", "word2", "word3", "word4"], FREQUENT_GRAM)


@register("o6_gathered_labels", """
SELECT doc_id, 'quality' AS label, CAST(quality AS BIGINT) AS value FROM labels
UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS BIGINT) FROM labels
""")
def o6_gathered_labels(spark, sf_dir):
    """The wide table of labels in long form, one row a document and label."""
    labels = read_table(spark, sf_dir, "labels")
    wide = labels.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return reshape.gather(wide, "label", "value", ["quality", "toxic"])


@register("s2_csv_reviews", """
SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(length(text)) AS BIGINT) AS length,
       CAST(sum(len(text) - len(replace(text, chr(10), ''))) AS BIGINT) AS line_ends
FROM documents GROUP BY ALL
""")
def s2_csv_reviews(spark, sf_dir):
    """All documents written as CSV (quotes and line ends inside texts) and read
    back with inferred column types, summed up by language and group."""
    path = shared_path(spark, "reviews")
    write_csv(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text"), path)
    back = read_csv(spark, path)
    ends = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    return back.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("n_chars").cast("long")).alias("n_chars"),
        F.sum(F.char_length("text").cast("long")).alias("length"), F.sum(ends.cast("long")).alias("line_ends"))


@register("s13_nested_roles", """
SELECT conv_id, role, count(*) AS n, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY ALL
""")
def s13_nested_roles(spark, sf_dir):
    """Turns by role of a stored nested collection (buckets of 64 turns); only
    the named parts of the nested rows are read, not their texts."""
    turns = read_table(spark, sf_dir, "conversations")
    nested = written_nested(turns, "conv_id", "reviews", ["turn", "role", "text"], bucket=F.floor(F.col("turn") / 64))
    flat = flatten(nested, "reviews", fields=["turn", "role"])
    return flat.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.max("turn").cast("long").alias("last_turn"))


@register("s5_corpus_middle_item", """
SELECT idx, url FROM (SELECT CAST(row_number() OVER (ORDER BY url) AS INTEGER) AS idx, url FROM pages) WHERE idx = 40
""")
def s5_corpus_middle_item(spark, sf_dir):
    """Id of the fortieth item of a corpus ordered by id."""
    return corpus_item(read_table(spark, sf_dir, "pages"), "url", 40, ["url"])


@register("w10_global_order", with_base("""
SELECT word, n, row_number() OVER (ORDER BY n, word) AS ord FROM (SELECT word, count(*) AS n FROM tidy GROUP BY word)
"""))
def w10_global_order(spark, sf_dir):
    """Place of every word in the order of counts over all groups."""
    return numbered(freq.count_by(tidy_tokens(spark, sf_dir), "word"), "n", "word", name="ord")


# ------------------------------------------------------------------ X4 language identification
def _grams_sql(src: str, key: str) -> str:
    """SQL for ``(key, g, cnt)``: char 1..3-grams of padded distinct tokens."""
    return f"""
SELECT {key}, g, sum(c) AS cnt FROM (
  SELECT {key}, c, unnest(list_transform(range(1, length(p) + 1), lambda i: substring(p, i, 1))) AS g FROM {src}
  UNION ALL
  SELECT {key}, c, unnest(list_transform(range(1, length(p)), lambda i: substring(p, i, 2))) AS g FROM {src}
  UNION ALL
  SELECT {key}, c, unnest(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS g FROM {src})
GROUP BY ALL"""


_LANG_SQL = f"""
ltok AS (SELECT lang, '_' || w || '_' AS p, count(*) AS c FROM (
  SELECT lang, unnest(regexp_extract_all(lower(text), {{P}})) AS w FROM documents WHERE lang IS NOT NULL)
  GROUP BY ALL),
lgram AS ({_grams_sql("ltok", "lang")}),
lp AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, g) AS pr FROM lgram QUALIFY pr <= 400),
"""


def _classify_sql(src: str, key: str, name: str) -> str:
    """CTEs ending in ``{name}(key, predicted)`` for texts in ``src(key, text)``."""
    return f"""
{name}_tok AS (SELECT {key}, '_' || w || '_' AS p, count(*) AS c FROM (
  SELECT {key}, unnest(regexp_extract_all(lower(text), {{P}})) AS w FROM {src}) GROUP BY ALL),
{name}_gram AS ({_grams_sql(name + "_tok", key)}),
{name}_dp AS (SELECT {key}, g, row_number() OVER (PARTITION BY {key} ORDER BY cnt DESC, g) AS r
              FROM {name}_gram QUALIFY r <= 400),
{name}_n AS (SELECT {key}, count(*) AS n FROM {name}_dp GROUP BY ALL),
{name}_m AS (SELECT {key}, lang, sum(abs(r - pr)) AS s, count(*) AS k FROM {name}_dp JOIN lp USING (g) GROUP BY ALL),
{name}_best AS (SELECT {key}, lang FROM (
  SELECT {key}, lang, s + 400 * (n - k) AS distance FROM {name}_m JOIN {name}_n USING ({key}))
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY distance, lang) = 1),
{name} AS (SELECT {key}, b.lang AS predicted FROM {name}_n LEFT JOIN {name}_best b USING ({key}))
"""


@register("x4_language_id", with_base(
    "SELECT doc_id, predicted FROM langid",
    _LANG_SQL + _classify_sql("documents", "doc_id", "langid")))
def x4_language_id(spark, sf_dir):
    """Language of every document from character n-gram profiles trained on
    the labelled documents (out-of-place distance, top 400 grams)."""
    docs = documents(spark, sf_dir, lang=None, cols=("doc_id", "lang", "text"))
    # texts are tokenised and counted once; training adds the counts up per
    # language (few distinct words), classifying keeps them apart.  The shuffle of
    # the counts, by other columns than the texts', is read by both
    key = ["doc_id", "label"]
    counted = spread(language.token_counts(docs.withColumnRenamed("lang", "label"), key), *key)
    profiles = language.train_counted(counted, "label")
    return language.classify(counted, profiles, key).drop("label")


# ------------------------------------------------------------------ C1 / S1 / S13 / P1 / P3 / P6 / P10 / P11 / J1
@register("c1_review_etl", with_base("""
SELECT l.listing_id, l.page_id, l.country, l.url, r.conv_id, r.turn, r.role, r.review_text
FROM (SELECT page_id, url, string_split(regexp_replace(url, '[?#].*$', ''), '/')[4] AS country,
             TRY_CAST(string_split(regexp_replace(url, '[?#].*$', ''), '/')[5] AS BIGINT) AS listing_id
      FROM pages JOIN listlang USING (page_id) WHERE listlang.predicted = 'en') l
JOIN rev r ON l.listing_id = r.conv_id
JOIN revlang USING (conv_id, turn)
WHERE revlang.predicted = 'en'
""", _LANG_SQL + """
rev AS (SELECT conv_id, turn, role, coalesce(role, 'NA') || '_' || coalesce(text, 'NA') AS review_text,
               coalesce(role, 'NA') || '_' || coalesce(text, 'NA') AS text FROM conversations),
listing AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages),
""" + _classify_sql("rev", "conv_id, turn", "revlang") + "," + _classify_sql("listing", "page_id", "listlang")))
def c1_review_etl(spark, sf_dir):
    """Listing/review ETL: review text united, languages of listing and review
    text detected (English kept), country lifted from the listing's address,
    listing id parsed from the URL, reviews joined to listings, columns pruned
    by position and renamed.  (A nested collection is read with ``flatten``.)"""
    reviews = spread(read_table(spark, sf_dir, "conversations"), "conv_id", "turn")
    reviews = reviews.select("conv_id", "turn", "role", unite("role", "text").alias("review_text"))
    docs = documents(spark, sf_dir, lang=None, cols=("doc_id", "lang", "text"))
    profiles = language.train(docs.select("lang", "text"))
    lang = language.classify(reviews.withColumnRenamed("review_text", "text"), profiles, ["conv_id", "turn"])
    english = reviews.join(lang.where(F.col("predicted") == "en").select("conv_id", "turn"),
                           ["conv_id", "turn"])
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    shown = F.regexp_replace("html", "<[^>]*>", " ")
    listed = language.classify(spread(pages.select("page_id", shown.alias("text")), "page_id"), profiles, "page_id")
    # the address of a listing, nested as in a document store
    country = separate(F.regexp_replace("url", r"[?#].*$", ""), 4, sep="/")
    listings = pages.select(url_id("url").alias("id"), "page_id", "url", "html",
                            F.struct(country.alias("country")).alias("address"))
    listings = reshape.lift(reshape.drop_at(listings, [4]), "address.country", "country")
    listings = reshape.rename_at(listings, 1, "listing_id")
    listings = listings.join(listed.where(F.col("predicted") == "en").select("page_id"), "page_id", "left_semi")
    return (listings.join(english, listings["listing_id"] == english["conv_id"])
            .select("listing_id", "page_id", "country", "url", "conv_id", "turn", "role", "review_text"))


# ------------------------------------------------------------------ S4 / S5 / S6 / S7
@register("s5_corpus_item_id", """
SELECT idx, url FROM (SELECT CAST(row_number() OVER (ORDER BY url) AS INTEGER) AS idx, url FROM pages) WHERE idx = 1
""")
def s5_corpus_item_id(spark, sf_dir):
    """Id (file name / URL) of the first item of a corpus ordered by id."""
    return corpus_item(read_table(spark, sf_dir, "pages"), "url", 1, ["url"])


@register("s5_corpus_item_language", """
SELECT idx, lang FROM (SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS idx, lang FROM documents) WHERE idx = 7
""")
def s5_corpus_item_language(spark, sf_dir):
    """Language of the seventh item of a corpus ordered by id."""
    return corpus_item(read_table(spark, sf_dir, "documents"), "doc_id", 7, ["lang"])


@register("s6_document_lines", """
SELECT doc_id, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line, unnest(parts) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
""")
def s6_document_lines(spark, sf_dir):
    """Every document as one row per text line (``line`` from 1)."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return lines(docs, "text", keep=["doc_id"])


@register("s7_doc_term_counts", with_base("""
SELECT doc_id, word AS term, count(*) AS n FROM tok GROUP BY ALL
"""))
def s7_doc_term_counts(spark, sf_dir):
    """Document-term counts ``(doc_id, term, n)`` (the input of a topic model)."""
    toks = unnest_tokens(documents(spark, sf_dir, cols=("doc_id", "text")))
    return freq.count_by(toks.withColumnRenamed("word", "term"), "doc_id", "term")


# ------------------------------------------------------------------ C20 / M3 / M4 / M5 / P14 / P19 / F5
def _lda(spark, sf_dir):
    arrays = topics.token_arrays(documents(spark, sf_dir, cols=("doc_id", "text")), "doc_id",
                                 drop=list(STOP_WORDS))
    return topics.fit_vem(topics.term_counts(arrays, "doc_id"), k=LDA_K, seed=LDA_SEED).beta


@register("m4_topic_beta")
def m4_topic_beta(spark, sf_dir):
    """Two-topic LDA (seed 123) of the documents; topic-term betas in long form."""
    return _lda(spark, sf_dir)


@register("c20_topic_log_ratio")
def c20_topic_log_ratio(spark, sf_dir):
    """Terms separating the two topics: spread betas, keep terms above the
    limits in either topic, ``log2(topic2 / topic1)``."""
    return topics.topic_log_ratio(_lda(spark, sf_dir))


# ------------------------------------------------------------------ F1 + W3/W4 (one group, global top-k) / P12 / P21
ONE_GROUP = "src1"


@register("w4_top_words_one_group", with_base(f"""
SELECT word, n FROM (SELECT word, count(*) AS n FROM tidy WHERE source = '{ONE_GROUP}' GROUP BY word)
QUALIFY rank() OVER (ORDER BY n DESC) <= {TOP_WORDS}
"""))
def w4_top_words_one_group(spark, sf_dir):
    """Top words of one group (filter, then a global tie-keeping top-k)."""
    toks = tidy_tokens(spark, sf_dir).where(F.col(GROUP) == ONE_GROUP)
    return freq.top_n(freq.count_by(toks, "word"), TOP_WORDS)


RECODE = [("src17", "Group 17"), ("src18", "Group 18"), ("src19", "Group 19")]


@register("p12_recode_groups", """
SELECT doc_id, source, replace(replace(replace(source, 'src17', 'Group 17'), 'src18', 'Group 18'), 'src19', 'Group 19')
       AS resort FROM documents
""")
def p12_recode_groups(spark, sf_dir):
    """Group names recoded by chained literal replacements (no name is part of
    another)."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", GROUP, recode(GROUP, RECODE).alias("resort"))


@register("p21_correlogram_axes", with_base(f"""
SELECT word, author, round(CASE WHEN proportion > 0 THEN log10(proportion) END, 9) AS x,
       round(CASE WHEN {BENCH_GROUP} > 0 THEN log10({BENCH_GROUP}) END, 9) AS y,
       CASE WHEN proportion IS NOT NULL THEN printf('%.2f%%', proportion * 100) END AS x_label,
       CASE WHEN {BENCH_GROUP} IS NOT NULL THEN printf('%.2f%%', {BENCH_GROUP} * 100) END AS y_label
FROM pairs
""", _FREQ_SQL))
def p21_correlogram_axes(spark, sf_dir):
    """Log10 plot coordinates of the correlogram table (words with both) and
    their percent labels."""
    f = paired_shares(spark, sf_dir)
    return f.select("word", "author", F.round(log10_axis("proportion"), R).alias("x"),
                    F.round(log10_axis(BENCH_GROUP), R).alias("y"),
                    percent_label("proportion").alias("x_label"),
                    percent_label(BENCH_GROUP).alias("y_label"))


# ------------------------------------------------------------------ helpers of the inventory in queries
@register("j7_table_stop_words", with_base("""
SELECT source, word, count(*) AS n FROM tidyc GROUP BY source, word
"""))
def j7_table_stop_words(spark, sf_dir):
    """Word counts per group without the words of a stop table that custom words
    are appended to (an anti join with the counted words)."""
    counts = freq.count_by(unnest_tokens(documents(spark, sf_dir)), GROUP, "word")
    return anti_join_words(counts, with_custom_words(spark, CUSTOM_WORDS))


@register("o4_bound_word_counts", with_base("""
SELECT source, word, count(*) AS n, 'documents' AS origin FROM tidy GROUP BY source, word
UNION ALL
SELECT NULL, word, count(*), 'benchmark' FROM (
  SELECT unnest(regexp_extract_all(lower(text), {P})) AS word FROM benchmark) GROUP BY word
"""))
def o4_bound_word_counts(spark, sf_dir):
    """Word counts of two text tables, tagged with their origin and bound by
    column name (the second has no group)."""
    docs = freq.count_by(tidy_tokens(spark, sf_dir), GROUP, "word")
    bench = freq.count_by(unnest_tokens(read_table(spark, sf_dir, "benchmark").select("text")), "word")
    return reshape.bind_rows(reshape.tag(docs, "origin", "documents"), reshape.tag(bench, "origin", "benchmark"))


@register("p9_separated_bigrams", with_base("""
SELECT source, word1, word2, count(*) AS n FROM bif GROUP BY ALL
""", _NGRAM_SQL))
def p9_separated_bigrams(spark, sf_dir):
    """Counted bigrams separated into their words, stop words removed."""
    counts = freq.count_by(_bigrams(spark, sf_dir, joined="bigram"), GROUP, "bigram")
    words = counts.select(GROUP, separate("bigram", 1).alias("word1"), separate("bigram", 2).alias("word2"), "n")
    return remove_stop_words(words, stop(), ["word1", "word2"])


@register("p20_rounded_lengths", """
SELECT doc_id, CAST(round_even(length(text) / 100.0, 0) * 100 AS BIGINT) AS n_chars FROM documents
""")
def p20_rounded_lengths(spark, sf_dir):
    """Text lengths rounded to hundreds, halves to the even hundred."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", round_half_even(F.char_length("text").cast("bigint"), -2).alias("n_chars"))


@register("s6_chosen_document_lines", """
SELECT doc_id, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line, unnest(parts) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
      WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
""")
def s6_chosen_document_lines(spark, sf_dir):
    """Documents chosen by a table of ids, one row per text line."""
    ids = read_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return lines(docs, "text", keep=["doc_id"])


@register("w10_words_by_median", with_base(f"""
, topw AS (SELECT source, word, n FROM (SELECT source, word, count(*) AS n FROM tidy GROUP BY source, word)
  QUALIFY rank() OVER (PARTITION BY source ORDER BY n DESC) <= {TOP_WORDS}),
pos AS (SELECT word, CAST(row_number() OVER (ORDER BY stat, word) AS INTEGER) AS ord FROM (
  SELECT word, round(median(n), 9) AS stat FROM topw GROUP BY word))
SELECT source, word, n, ord FROM topw JOIN pos USING (word)
"""))
def w10_words_by_median(spark, sf_dir):
    """Top words per group; a word has one display position in all groups, by
    the median of its counts."""
    counts = freq.count_by(tidy_tokens(spark, sf_dir), GROUP, "word")
    return freq.order_by_stat(freq.top_n(counts, TOP_WORDS, "n", group=[GROUP]), "n", "word", "median")


SHARE_TOPICS = ["src0", "src1"]


@register("m5_share_log_ratio", with_base(f"""
, c AS (SELECT source, word AS term, count(*) AS n FROM tidy
  WHERE source IN ('{SHARE_TOPICS[0]}', '{SHARE_TOPICS[1]}') GROUP BY ALL),
b AS (SELECT term, source, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY source) AS beta FROM c),
w AS (SELECT term, max(beta) FILTER (source = '{SHARE_TOPICS[0]}') AS topic1,
             max(beta) FILTER (source = '{SHARE_TOPICS[1]}') AS topic2 FROM b GROUP BY term)
SELECT term, round(topic1, 9) AS topic1, round(topic2, 9) AS topic2, round(log2(topic2 / topic1), 9) AS log_ratio
FROM w WHERE topic1 > {topics.TOPIC1_LIMIT} OR topic2 > {topics.TOPIC2_LIMIT}
"""))
def m5_share_log_ratio(spark, sf_dir):
    """The topic comparison on two topics known in advance: the term shares of
    two groups."""
    counts = freq.count_by(tidy_tokens(spark, sf_dir).where(F.col(GROUP).isin(SHARE_TOPICS)), GROUP, "word")
    shares = freq.share_within(counts, [GROUP], name="beta")
    beta = shares.select(F.when(F.col(GROUP) == SHARE_TOPICS[0], 1).otherwise(2).alias("topic"),
                         F.col("word").alias("term"), "beta")
    out = topics.topic_log_ratio(beta)
    return out.select("term", *[F.round(c, R).alias(c) for c in ("topic1", "topic2", "log_ratio")])


@register("m4_topic_totals", with_base(f"""
SELECT CAST(t.topic AS INTEGER) AS topic, (SELECT count(DISTINCT word) FROM tidy) AS n_terms, 1.0::DOUBLE AS beta_sum
FROM range(1, {LDA_K} + 1) t(topic)
"""))
def m4_topic_totals(spark, sf_dir):
    """Terms and total beta of each topic: the model leaves no term out."""
    return _lda(spark, sf_dir).groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("beta"), 6).alias("beta_sum"))
