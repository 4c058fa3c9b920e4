"""Tokenizer, n-grams and stop-word removal."""

from pyspark.sql import functions as F

from wordloom.operators import freq
from wordloom.operators.tokens import remove_stop_words, unnest_ngrams, unnest_tokens
from wordloom.sources import lexicons
from wordloom.sources.tables import literal_lines

# own lines with an inner apostrophe, digits, a currency sign, a hyphen and a repeated word
LINES = [
    "Well, we ought to sort the shed today.",
    "In the 1920s the mill wasn't for sale.",
    "Lanterns hung by the door, and more lanterns by the gate.",
    "There's a half-built boat; they've kept the lanterns for it.",
    "The oil cost £200, the lanterns nothing, the boat a little more.",
]


def test_tokens_of_literal_lines(spark):
    df = literal_lines(spark, LINES)
    toks = unnest_tokens(df, position="pos")
    assert toks.columns == ["line", "pos", "word"]
    first = [r.word for r in toks.where("line = 1").orderBy("pos").collect()]
    assert first == ["well", "we", "ought", "to", "sort", "the", "shed", "today"]
    words = {r.word for r in toks.collect()}
    assert {"wasn't", "1920s", "there's", "200", "half", "built", "they've"} <= words
    assert "£200" not in words and "" not in words


def test_small_text_word_count(spark):
    toks = remove_stop_words(unnest_tokens(literal_lines(spark, LINES)), lexicons.STOP_WORDS)
    top = freq.count_by(toks, "word", sort=True).collect()
    assert (top[0].word, top[0].n) == ("lanterns", 4)
    assert {r.word for r in top[:4]} >= {"lanterns", "boat"}
    # the same result through the table form of the stop list
    via_table = remove_stop_words(unnest_tokens(literal_lines(spark, LINES)), lexicons.stop_words(spark))
    assert sorted(map(tuple, freq.count_by(via_table, "word").collect())) == \
        sorted(map(tuple, freq.count_by(toks, "word").collect()))


def test_stop_word_removal_keeps_nulls(spark):
    df = spark.createDataFrame([("the",), (None,), ("cat",)], "word string")
    by_list = {r.word for r in remove_stop_words(df, ["the"]).collect()}
    by_table = {r.word for r in remove_stop_words(df, lexicons.word_table(spark, ["the"], "x")).collect()}
    assert by_list == by_table == {None, "cat"}


def test_ngram_counts_property(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x y"), (3, "solo"), (4, "")], "id int, text string")
    for n in (2, 3, 4):
        grams = unnest_ngrams(df, n)
        per_doc = {r.id: r.c for r in grams.groupBy("id").agg(F.count(F.lit(1)).alias("c")).collect()}
        sizes = {1: 5, 2: 2, 3: 1, 4: 0}
        for i, size in sizes.items():
            assert per_doc[i] == max(size - n + 1, 1)  # short texts give one null row
        nulls = grams.where(F.col("word1").isNull()).count()
        assert nulls == sum(1 for s in sizes.values() if s < n)


def test_bigram_columns_and_joined(spark):
    df = spark.createDataFrame([(1, "Not good, not bad")], "id int, text string")
    rows = unnest_ngrams(df, 2, joined="bigram").collect()
    assert [(r.word1, r.word2, r.bigram) for r in rows] == [
        ("not", "good", "not good"), ("good", "not", "good not"), ("not", "bad", "not bad")]
