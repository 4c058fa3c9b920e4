"""Count gates, global order, stored collections, inferred CSV, native p-values."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixture_paths import SF001
from wordloom.functions.stats import p_value_col, t_two_sided_p
from wordloom.operators import freq
from wordloom.operators.tokens import unnest_ngrams
from wordloom.plans.catalog import QUERIES
from wordloom.plans.common import documents
from wordloom.sources.tables import (corpus_item, flatten, numbered, read_csv, read_table, write_csv,
                                     written_nested)


@pytest.mark.parametrize("cells", [64, 1 << 12, freq.CELLS])
def test_gated_counts_are_exact(spark, cells):
    rng = np.random.default_rng(1)
    rows = [(f"g{k % 3}", f"w{int(w)}" if w else None) for k, w in enumerate(rng.zipf(1.3, 4000) % 900)]
    df = spark.createDataFrame(rows, "g string, w string").repartition(4)
    for least in (1, 2, 5, 10_000):
        got = {(r.g, r.w): r.n for r in freq.count_frequent(df, "g", "w", least=least, cells=cells).collect()}
        assert got == {k: n for k, n in Counter(rows).items() if n >= least}
    assert freq.count_frequent(df.limit(0), "g", "w", least=1, cells=cells).count() == 0


@pytest.mark.parametrize("cells", [64, freq.CELLS])
def test_pruned_ngrams_equal_plain_counts(spark, cells):
    rng = np.random.default_rng(2)
    texts = [(i % 2, " ".join(f"w{int(w)}" for w in rng.zipf(1.5, 60) % 40)) for i in range(40)]
    texts += [(0, "a b c d e f a b c d"), (0, "a b c d"), (1, ""), (1, None)]
    grams = unnest_ngrams(spark.createDataFrame(texts, "g int, text string"), 4).where("word1 is not null")
    words = ["word1", "word2", "word3", "word4"]
    plain = Counter((g, *t[k:k + 4]) for g, t in ((g, (t or "").split()) for g, t in texts) for k in range(len(t) - 3))
    got = {tuple(r[:5]): r.n for r in freq.frequent_ngrams(grams, ["g"], words, 3, cells).collect()}
    assert got == {k: n for k, n in plain.items() if n >= 3} and len(got) > 5


def test_the_gate_spares_the_shuffle(spark):
    grams = unnest_ngrams(documents(spark, SF001), 4).where("word1 is not null")
    words = ["word1", "word2", "word3", "word4"]
    every = grams.select("source", *words).distinct().count()
    gate = freq.cell_gate(grams, F.struct("source", *words), 3)
    assert grams.where(gate).select("source", *words).distinct().count() < every / 50
    plan = freq.frequent_ngrams(grams, ["source"], words, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan  # the gates are scalars, not joined tables


def test_global_order_at_any_place(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a) if a else None, f"s{b}") for a, b in zip(rng.integers(0, 50, 700), rng.permutation(700))]
    rows += [(7, f"hot{k:04d}") for k in range(900)]
    df = spark.createDataFrame(rows, "k long, s string").repartition(6)
    got = sorted((r.idx, r.k, r.s) for r in numbered(df, "k", "s").collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [g[1:] for g in got] == want and [g[0] for g in got] == list(range(1, len(rows) + 1))
    names = sorted(s for _, s in rows)
    for i in (1, 800, len(rows)):
        assert [tuple(r) for r in corpus_item(df, "s", i, ["s"]).collect()] == [(i, names[i - 1])]
    assert corpus_item(df, "s", len(rows) + 1, ["s"]).count() == 0
    assert numbered(df.limit(0), "k").count() == 0


def test_no_task_orders_everything(spark):
    plan = QUERIES["w10_global_order"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window "):]
    # the one window without a key runs over the sizes of the ranges
    assert plan.count("Window [") == 1 and "sum(_n" in window.split("\n")[0]


def test_stored_collection_reads_only_named_parts(spark):
    turns = read_table(spark, SF001, "conversations")
    nested = written_nested(turns, "conv_id", "reviews", ["turn", "role", "text"], bucket=F.floor(F.col("turn") / 2))
    flat = flatten(nested, "reviews", fields=["turn", "role"])
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,reviews:array<struct<turn:" in plan and "text" not in plan.split("ReadSchema")[1]
    want = sorted(map(tuple, turns.select("conv_id", "turn", "role").collect()))
    assert sorted(map(tuple, flat.select("conv_id", "turn", "role").collect())) == want
    one = flatten(nested, "reviews", fields=["role"])
    assert "role:string>>>" in one._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    assert Counter(r.role for r in one.collect()) == Counter(w[2] for w in want)
    assert nested.where(F.size("reviews") > 2).count() == 0


def test_csv_types_are_inferred(spark, tmp_path):
    rows = [(1, 2.5, 'said "x",\nand left', True), (2, -1.0, "a,b", False), (3, None, "", None)]
    df = spark.createDataFrame(rows, "id int, score double, text string, ok boolean")
    write_csv(df, f"{tmp_path}/t")
    back = read_csv(spark, f"{tmp_path}/t")
    assert dict(back.dtypes) == {"id": "int", "score": "double", "text": "string", "ok": "boolean"}
    assert [tuple(r)[:3] for r in back.orderBy("id").collect()][:2] == [r[:3] for r in rows[:2]]


def exact_p(t, df):
    """Student's t with whole degrees of freedom as a finite series."""
    th = math.atan(abs(t) / math.sqrt(df))
    if df == 1:
        return 1 - 2 * th / math.pi
    term, terms = (1.0, []) if df % 2 == 0 else (math.cos(th), [])
    for k in range((df if df % 2 == 0 else df - 1) // 2):
        terms.append(term)
        odd = 2 * k + 1 if df % 2 == 0 else 2 * k + 2
        term *= odd / (odd + 1) * math.cos(th) ** 2
    if df % 2 == 0:
        return 1 - math.sin(th) * math.fsum(terms)
    return 1 - 2 / math.pi * (th + math.sin(th) * math.fsum(terms))


def test_native_p_values(spark):
    rows = [(t, float(df)) for t in (-40.0, -2.1, -1e-6, 0.0, 0.3, 1.0, 1.96, 4.5, 30.0)
            for df in (1, 2, 3, 4, 9, 30, 101, 1000, 25_000)]
    edge = [(None, 5.0), (float("nan"), 5.0), (1.0, 0.0), (float("inf"), 3.0), (1.0, -2.0), (1.0, None), (2.0, 4e6)]
    df = spark.createDataFrame(rows + edge, "t double, df double")
    out = df.select("t", "df", p_value_col(F.col("t"), F.col("df")).alias("p"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = [r.p for r in out.collect()]
    for (t, d), p in zip(rows, got):
        assert math.isclose(p, exact_p(t, int(d)), abs_tol=2e-11), (t, d, p)
        assert math.isclose(p, t_two_sided_p(t, d), rel_tol=1e-12, abs_tol=1e-300)
    rest = got[len(rows):]
    assert rest[:3] == [None, None, None] and rest[3] == 0.0 and rest[4:6] == [None, None]
    assert math.isclose(rest[6], math.erfc(2 / math.sqrt(2)), rel_tol=1e-5)


def test_p_value_query_runs_without_python(spark):
    plan = QUERIES["a9_cor_test_pvalue"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Arrow" not in plan


def test_fourgrams_are_pruned_in_one_pass(spark):
    df = QUERIES["f4_frequent_fourgrams"](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # one bitmap for the gates of all pairs, so the texts are read for it and for the counts
    assert len(set(re.findall(r"Subquery subquery#\d+", plan))) == 1


def test_csv_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    df = spark.range(9001).selectExpr("id", "concat('a\n\"b\" ', id) AS text").repartition(1)
    write_csv(df, f"{tmp_path}/t")
    back = read_csv(spark, f"{tmp_path}/t")
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 5 and max(sizes) == 2000 and sum(sizes) == 9001
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
