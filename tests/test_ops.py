"""Counting, top-k ties, shares, reshaping, tf-idf, correlation, phi."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wordloom.operators import freq, pairwise, reshape, stats
from wordloom.operators.pairwise import pairwise_cor, pairwise_cor_anchored


def test_top_n_ties(spark):
    df = spark.createDataFrame([("g", "a", 5), ("g", "b", 4), ("g", "c", 4), ("g", "d", 1), ("h", "e", 2),
                                ("h", "f", None)], "g string, w string, n int")
    kept = freq.top_n(df, 2, "n", group=["g"])
    assert sorted((r.g, r.w) for r in kept.collect()) == [("g", "a"), ("g", "b"), ("g", "c"), ("h", "e")]
    cut = freq.top_n(df, 2, "n", group=["g"], ties=False)
    assert sorted((r.g, r.w) for r in cut.collect()) == [("g", "a"), ("g", "b"), ("h", "e")]
    glob = freq.top_n(df, 1, "n")
    assert [r.w for r in glob.collect()] == ["a"]


def test_top_n_plan_limits_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("n"))
    plan = freq.top_n(df, 3, "n", group=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_share_within_sums_to_one(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 2), (None, "z", 5)],
                               "g string, w string, n long")
    out = freq.share_within(df, ["g"])
    sums = {r.g: r.s for r in out.groupBy("g").agg(F.sum("proportion").alias("s")).collect()}
    assert all(abs(v - 1.0) < 1e-12 for v in sums.values()) and None in sums


def test_keep_frequent_and_histogram(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)] * 2, "w string")
    assert sorted(r.w or "-" for r in freq.keep_frequent(df, "w", 2).collect()) == ["-", "-", "a", "a", "a"]
    h = spark.createDataFrame([("g", 0.0), ("g", 0.5), ("g", 1.0), ("g", 2.0)], "g string, x double")
    bins = {r.bin: r.n for r in freq.histogram(h, "x", ["g"], hi=1.0, bins=2).collect()}
    assert bins == {0: 1, 1: 2}


def test_wide_order_equals_plain_order(spark):
    rng = np.random.default_rng(5)
    rows = [("g" if rng.random() < 0.7 else None, f"w{i}", int(rng.integers(0, 9)) or None) for i in range(200)]
    df = spark.createDataFrame(rows, "grp string, word string, n int")
    plain = freq.order_column(df, "n", "word", group=["grp"])
    wide = freq.order_column_wide(df, "n", "word", group=["grp"])
    assert sorted(map(str, plain.collect())) == sorted(map(str, wide.collect()))


def test_order_by_mean_and_median(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 9.0), ("a", "y", 4.0), ("c", "x", 2.0)],
                               "g string, w string, v double")
    mean = {r.w: r.ord for r in freq.order_by_stat(df, "v", "w").collect()}
    assert mean == {"x": 1, "y": 2}  # both 4.0: ties by label
    rows = freq.order_by_stat(df.union(spark.createDataFrame([("d", "x", 99.0)], df.schema)), "v", "w", "median")
    assert {r.w: r.ord for r in rows.collect()} == {"y": 1, "x": 2} and rows.count() == 5


def test_spread_gather_round_trip(spark):
    df = spark.createDataFrame([("w1", "A", 0.1), ("w1", "B", 0.2), ("w2", "A", 0.3)],
                               "word string, author string, p double")
    wide = reshape.spread(df, "author", "p", ["A", "B"])
    back = reshape.gather(wide, "author", "p", ["A", "B"])
    got = sorted((r.word, r.author, r.p) for r in back.collect())
    assert got == [("w1", "A", 0.1), ("w1", "B", 0.2), ("w2", "A", 0.3), ("w2", "B", None)]
    both = reshape.bind_rows(df, df.select("word").withColumn("extra", F.lit(1)))
    assert set(both.columns) == {"word", "author", "p", "extra"} and both.count() == 6


def test_natural_join_and_positions(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "word string, k int")
    b = spark.createDataFrame([("x", 1, "pos"), ("x", 1, "trust")], "word string, k int, sentiment string")
    assert reshape.natural_join(a, b).count() == 2
    assert reshape.drop_at(b, [2]).columns == ["word", "sentiment"]
    assert reshape.rename_at(b, 3, "s").columns == ["word", "k", "s"]


def test_tf_idf_small(spark):
    df = spark.createDataFrame([("d1", "a", 2), ("d1", "b", 2), ("d2", "a", 1)], "doc string, term string, n long")
    rows = {(r.doc, r.term): r for r in stats.tf_idf(df, "term", "doc", total="total").collect()}
    assert rows[("d1", "a")].idf == 0.0
    assert math.isclose(rows[("d1", "b")].tf_idf, 0.5 * math.log(2))
    assert rows[("d1", "b")].total == 4


def test_cor_test_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    y = x * 0.5 + rng.normal(size=50)
    pdf = pd.DataFrame({"g": "a", "x": x, "y": y})
    pdf.loc[3, "y"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    r = stats.cor_test(df, "x", "y", ["g"]).collect()[0]
    m = ~np.isnan(pdf["y"].to_numpy())
    ref = np.corrcoef(x[m], pdf["y"].to_numpy()[m])[0, 1]
    assert r.n == 49 and r.df == 47 and math.isclose(r.estimate, ref, rel_tol=1e-9)
    assert r.conf_low < r.estimate < r.conf_high and 0 < r.p_value < 1


def _phi_brute(pairs):
    feats = sorted({f for _, f in pairs})
    items = sorted({i for i, _ in pairs})
    m = np.array([[1.0 if (i, f) in pairs else 0.0 for f in feats] for i in items])
    out = {}
    for a in range(len(items)):
        for b in range(len(items)):
            if a != b:
                sa, sb = m[a].std(), m[b].std()
                out[(items[a], items[b])] = None if sa == 0 or sb == 0 else float(np.corrcoef(m[a], m[b])[0, 1])
    return out


def test_pairwise_cor_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(f"w{rng.integers(0, 40)}", int(rng.integers(0, 60))) for _ in range(900)]
    rows += [("everywhere", f) for f in range(60)] + [("w1", 1), ("w1", 1)]  # zero variance, duplicates
    df = spark.createDataFrame(rows, "word string, doc long")
    ref = _phi_brute(set(rows))
    got = {(r.item1, r.item2): r.correlation for r in pairwise_cor(df, "word", "doc").collect()}
    docs = {}
    for w, d in rows:
        docs.setdefault(w, set()).add(d)
    assert set(got) == {k for k in ref if docs[k[0]] & docs[k[1]]}
    for k, v in got.items():
        assert (v is None and ref[k] is None) or math.isclose(v, ref[k], abs_tol=1e-9)
    anch = {(r.item1, r.item2): r.correlation
            for r in pairwise_cor_anchored(df, "word", "doc", ["w3", "everywhere"]).collect()}
    assert set(anch) == {k for k in ref if k[0] in ("w3", "everywhere")}
    for k, v in anch.items():
        assert (v is None and ref[k] is None) or math.isclose(v, ref[k], abs_tol=1e-9)


def test_pairwise_cor_drops_null_features(spark):
    rows = [("a", "1"), ("a", "2"), ("a", None), ("b", "1"), ("b", None), ("c", "3"), (None, "1")]
    df = spark.createDataFrame(rows, "word string, doc string")
    ref = _phi_brute({r for r in rows if None not in r})
    got = {(r.item1, r.item2): r.correlation for r in pairwise_cor(df, "word", "doc").collect()}
    assert set(got) == {("a", "b"), ("b", "a")}
    assert math.isclose(got["a", "b"], ref["a", "b"], abs_tol=1e-9)
    anch = {(r.item1, r.item2): r.correlation for r in pairwise_cor_anchored(df, "word", "doc", ["a"]).collect()}
    assert set(anch) == {("a", "b"), ("a", "c")}
    assert all(math.isclose(v, ref[k], abs_tol=1e-9) for k, v in anch.items())


def test_anchored_cor_counts_rare_items_and_features_without_frequent_ones(spark, monkeypatch):
    """Lists and rows give the same as counting by hand: repeated features, no
    feature, no item, items below the threshold, features without a tried item."""
    rows = ([(i % 7, ["a", "b", "b", None]) for i in range(21)] + [(i, ["c", "rare"]) for i in range(7, 12)]
            + [(20, ["d"] * 5 + ["b"]), (21, ["once"]), (22, []), (23, None), (None, ["a", "c", "d"]), (None, ["d", "e"] * 3)]
            + [(30 + i, ["e"]) for i in range(2)])
    least = 6
    total = Counter(w for _, ws in rows for w in ws or [] if w)
    held = defaultdict(set)
    for f, ws in rows:
        for w in ws or []:
            if w and f is not None and total[w] >= least:
                held[w].add(f)
    n = len(set().union(*held.values()))
    want = {}
    for a in ("a", "e", "rare", "absent"):
        for b in held:
            if a in held and a != b:
                x, y, both = len(held[a]), len(held[b]), len(held[a] & held[b])
                want[a, b] = (n * both - x * y) / math.sqrt(x * (n - x) * y * (n - y))
    monkeypatch.setattr(pairwise, "TRIED", 1)
    lists = spark.createDataFrame(rows, "doc long, word array<string>")
    for df in (lists, lists.select("doc", F.explode("word").alias("word"))):
        out = pairwise.pairwise_cor_anchored(df.repartition(3), "word", "doc", ["a", "e", "rare", "absent"], least)
        got = {(r.item1, r.item2): r.correlation for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_anchored_cor_shuffles_lists_not_presence_rows(spark):
    """Beyond one row a feature only counts of items are shuffled: no row of an item and a feature."""
    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i % 5)]) for i in range(40)], "doc long, word array<string>")
    plan = pairwise.pairwise_cor_anchored(df, "word", "doc", ["w1"])._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\), ENSURE", plan))
    assert dealt and not any("item" in d and "feature" in d for d in dealt)
