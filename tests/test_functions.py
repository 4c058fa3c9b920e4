"""Scalar column helpers and the null rules."""

import math

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.functions.stats import t_two_sided_p


def test_extract_word_null_when_no_match(spark):
    df = spark.createDataFrame([("don't",), ("1580s",), ("2024",), ("éclair",)], "w string")
    got = [r.x for r in df.select(T.extract_word("w").alias("x")).collect()]
    assert got == ["don't", "s", None, "clair"]


def test_unite_writes_na_for_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    assert [r.u for r in df.select(T.unite("x", "y").alias("u")).collect()] == ["a_NA", "b_c"]


def test_url_id_never_fails(spark):
    df = spark.createDataFrame([("http://h.example.com/en/825?page=2",), ("https://h.example.org/en/25#top",),
                                ("short",), (None,)], "url string")
    got = [r.i for r in df.select(T.url_id("url").alias("i")).collect()]
    assert got == [825, 25, None, None]


def test_recode_and_sign(spark):
    df = spark.createDataFrame([("Shop_North", 3), ("Shop_South", -1), ("x", None)],
                               "b string, v int")
    rec = T.recode("b", [("Shop_South", "South"), ("Shop_North", "North")])
    rows = df.select(rec.alias("r"), T.sign_label("v").alias("s")).collect()
    assert [(r.r, r.s) for r in rows] == [("North", "positive"), ("South", "negative"), ("x", None)]


def test_separate_missing_part_is_null(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "s string")
    rows = df.select(T.separate("s", 1).alias("a"), T.separate("s", 2).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [("a", "b"), ("c", None)]


@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.984, 100, 0.05),
                                    (2.576, 1e6, 0.01), (0.0, 5, 1.0)])
def test_t_pvalue_table(t, df, p):
    assert abs(t_two_sided_p(t, df) - p) < 5e-4


def test_t_pvalue_extremes():
    assert t_two_sided_p(300.0, 1800) < 1e-300
    assert math.isnan(t_two_sided_p(1.0, 0))
