"""Registered queries: contract, oracle agreement on the smallest scale, properties."""

import math

from pyspark.sql import functions as F

from fixture_paths import SF001, SF01
from oracle_check import compare, duck

import __spark_entry__ as entry_mod
from wordloom.plans.catalog import ORACLE, QUERIES


def test_contract(spark):
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 30
    df = entry_mod.entry(spark)
    assert df.count() > 0 and "tf_idf" in df.columns


def test_every_oracle_query_matches_at_smallest_scale(spark):
    con = duck(SF001)
    bad = []
    for name in sorted(ORACLE):
        r = compare(spark, con, name, SF001)
        if r["status"] != "ok":
            bad.append(r)
    assert not bad, bad


def test_rows_only_queries_have_rows(spark):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, SF001).count() > 0, name


def test_unlisted_group_takes_part(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "en", "src0", "oak elm oak ash yew"), (2, "en", "src20", "oak elm elm fir yew yew")],
        "doc_id long, lang string, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.word: r for r in QUERIES["c2_correlogram"](spark, str(tmp_path)).collect()}
    assert {r.author for r in rows.values()} == {"src20"}
    assert set(rows) == {"oak", "elm", "ash", "yew", "fir"} and rows["ash"].proportion is None


def test_topic_betas_sum_to_one(spark):
    beta = QUERIES["m4_topic_beta"](spark, SF001)
    sums = [r.s for r in beta.groupBy("topic").agg(F.sum("beta").alias("s")).collect()]
    assert len(sums) == 2 and all(abs(s - 1) < 1e-6 for s in sums)


def test_language_id_accuracy_on_held_out_documents(spark):
    from wordloom.operators import language
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang", "text")
    profiles = language.train(docs.where("doc_id % 2 = 0").select("lang", "text"))
    held_out = docs.where("doc_id % 2 = 1 and lang is not null")
    j = language.classify(held_out.select("doc_id", "text"), profiles, "doc_id").join(held_out, "doc_id")
    n = j.count()
    assert n > 300 and j.where(F.col("lang") == F.col("predicted")).count() / n > 0.95


def test_phi_symmetric_and_bounded(spark):
    phi = QUERIES["c19_pairwise_cor"](spark, SF001)
    rows = {(r.item1, r.item2): r.correlation for r in phi.collect()}
    for (a, b), v in rows.items():
        assert v is None or -1 - 1e-9 <= v <= 1 + 1e-9
        assert (rows[(b, a)] is None) == (v is None)
        assert v is None or math.isclose(v, rows[(b, a)], abs_tol=1e-12)


def test_oracle_column_types_match(spark):
    con = duck(SF001)
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    for name in sorted(ORACLE):
        spark_types = dict(QUERIES[name](spark, SF001).dtypes)
        res = con.sql(ORACLE[name])
        duck_types = dict(zip(res.columns, [str(t) for t in res.types]))
        for col, t in spark_types.items():
            assert names.get(t, t) == duck_types[col], (name, col, t, duck_types[col])


def test_idf_non_negative_and_tf_sums(spark):
    t = QUERIES["a11_tf_idf"](spark, SF001)
    assert t.where(F.col("idf") < 0).count() == 0
    sums = [r.s for r in t.groupBy("source").agg(F.sum("tf").alias("s")).collect()]
    assert all(abs(s - 1) < 1e-6 for s in sums)


def test_ngram_rows_match_token_counts_on_documents(spark):
    from wordloom.functions.text import tokens
    from wordloom.operators.tokens import unnest_ngrams
    from wordloom.plans.common import documents
    docs = documents(spark, SF001)
    sizes = [r.n for r in docs.select(F.size(tokens("text")).alias("n")).collect()]
    for n in (2, 4):
        want = sum(max(s - n + 1, 0) if s >= n else 1 for s in sizes)
        assert unnest_ngrams(docs, n).count() == want


def test_p_values_consistent_with_statistic(spark):
    from wordloom.functions.stats import t_two_sided_p
    from wordloom.operators.stats import cor_test
    from wordloom.plans.catalog import BENCH_GROUP, paired_shares
    # the operator's own values; the query rounds them
    exact = {r.author: r for r in cor_test(paired_shares(spark, SF001), "proportion", BENCH_GROUP, ["author"]).collect()}
    rows = QUERIES["a9_cor_test_pvalue"](spark, SF001).collect()
    c3 = {r.author: r for r in QUERIES["c3_cor_test"](spark, SF001).collect()}
    assert len(rows) == len(c3) == len(exact) > 0
    for r in rows:
        e = exact[r.author]
        assert 0.0 <= r.p_value <= 1.0
        assert math.isclose(e.p_value, t_two_sided_p(e.statistic, float(e.df)), rel_tol=1e-12, abs_tol=1e-300)
        assert math.isclose(r.p_value, e.p_value, abs_tol=5.1e-10)
        assert (r.n, r.estimate, r.statistic) == (c3[r.author].n, c3[r.author].estimate, c3[r.author].statistic)


def test_topic_log_ratio_rows(spark):
    from wordloom.operators.topics import TOPIC1_LIMIT, TOPIC2_LIMIT
    rows = QUERIES["c20_topic_log_ratio"](spark, SF001).collect()
    assert rows
    for r in rows:
        assert r.topic1 > TOPIC1_LIMIT or r.topic2 > TOPIC2_LIMIT
        if r.topic1 and r.topic2:
            assert math.isclose(r.log_ratio, math.log2(r.topic2 / r.topic1), rel_tol=1e-9, abs_tol=1e-12)


def test_correlogram_of_words_on_one_side_only(spark, tmp_path):
    from wordloom.plans.catalog import frequency_table
    rows = [(1, "alpha alpha beta 77", "en", "src0"), (2, "alpha gamma gamma gamma", "en", "src1"),
            (3, "beta", "en", "src2"), (4, None, "en", "src2"), (5, "alpha", "en", None), (6, "delta", "de", "src3")]
    def table(rows, name):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return {(r.word, r.author): (r.src0, r.proportion)
                for r in frequency_table(spark, f"{tmp_path}/{name}").collect()}
    # 77 holds no letter: its word is null, and a word like the others
    assert table(rows, "a") == {
        ("alpha", "src1"): (0.5, 0.25), ("alpha", "src2"): (0.5, None), ("beta", "src1"): (0.25, None),
        ("beta", "src2"): (0.25, 1.0), (None, "src1"): (0.25, None), (None, "src2"): (0.25, None),
        ("gamma", "src1"): (None, 0.75)}
    assert table(rows[:1], "only_benchmark") == {}
    assert set(table(rows[1:3], "no_benchmark")) == {("alpha", "src1"), ("gamma", "src1"), ("beta", "src2")}
    assert table(rows[:0], "empty") == {}
