"""Topic model: against a plain per-document version, SQL on written betas, properties."""

import math

import duckdb
import numpy as np
import xxhash

from fixture_paths import SF001
from wordloom.operators import topics
from wordloom.plans.catalog import LDA_SEED, QUERIES


def test_gamma_functions():
    x = np.array([1e-3, 0.02, 0.5, 1.0, 3.7, 25.0, 4e5])
    assert np.allclose(topics.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-5 * x
    slope = [(math.lgamma(v + d) - math.lgamma(v - d)) / (2 * d) for v, d in zip(x, h)]
    assert np.allclose(topics.digamma(x), slope, rtol=1e-6, atol=1e-8)
    assert np.allclose(topics.trigamma(x), (topics.digamma(x + h) - topics.digamma(x - h)) / (2 * h), rtol=1e-6)
    assert math.isclose(float(topics.digamma(1.0)), -0.5772156649015329, rel_tol=1e-11)
    assert math.isclose(float(topics.trigamma(1.0)), math.pi ** 2 / 6, rel_tol=1e-8)


def plain_fit(docs, weights, alpha, max_iter, tolerance):
    """Plain version: documents one by one in log space; ``docs`` are lists of (term, n)."""
    k = weights.shape[1]
    bounds = []
    while len(bounds) < max_iter:
        log_beta = np.log(weights) - np.log(weights.sum(axis=0))
        new, total_bound, statistic = np.zeros_like(weights), 0.0, 0.0
        for doc in docs:
            idx, n = (np.array(c) for c in zip(*doc))
            gamma, before = np.full(k, alpha + n.sum() / k), None
            for step in range(topics.DOC_STEPS):
                score = topics.digamma(gamma) + log_beta[idx]
                log_phi = score - np.logaddexp.reduce(score, axis=1)[:, None]
                phi = np.exp(log_phi)
                gamma = alpha + (n[:, None] * phi).sum(axis=0)
                e = topics.digamma(gamma) - topics.digamma(gamma.sum())
                bound = (math.lgamma(k * alpha) - k * math.lgamma(alpha) + (alpha - 1) * e.sum()
                         - math.lgamma(gamma.sum()) + sum(map(math.lgamma, gamma)) - ((gamma - 1) * e).sum()
                         + (n[:, None] * phi * (e - log_phi + log_beta[idx])).sum())
                if before is not None and abs((before - bound) / before) < topics.DOC_TOLERANCE:
                    break
                before = bound
            np.add.at(new, idx, n[:, None] * phi)
            total_bound += bound
            statistic += e.sum()
        weights, alpha = new, topics.best_alpha(len(docs), statistic, k)
        bounds.append(total_bound)
        if len(bounds) > 2 and abs((bounds[-2] - bounds[-1]) / bounds[-2]) <= tolerance:
            break
    return weights / weights.sum(axis=0), alpha, bounds


def spark_hash(seed, j, term):
    def signed(v):
        return v - (1 << 64) if v >> 63 else v
    h = 42
    for part in (seed.to_bytes(4, "little"), j.to_bytes(4, "little"), term.encode()):
        h = xxhash.xxh64_intdigest(part, seed=h)
    return h


def test_fit_equals_the_plain_version(spark):
    arrays = topics.token_arrays(spark.read.parquet(f"{SF001}/documents.parquet").where("lang = 'en'"), "doc_id")
    counts = topics.term_counts(arrays, "doc_id")
    for k, steps in ((2, 1000), (3, 4)):
        fit = topics.fit_vem(counts, k=k, seed=LDA_SEED, max_iter=steps, block_counts=3000)
        rows = counts.collect()
        terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        docs = {}
        for r in rows:
            docs.setdefault(r.doc, []).append((terms[r.term], r.n))
        # the operator's start weights, from their definition
        start = np.array([[((spark_hash(LDA_SEED, j, t) >> 11) + 0.5) / 2.0 ** 53 + 1 / len(terms) for j in range(k)]
                          for t in terms])
        beta, alpha, bounds = plain_fit(list(docs.values()), start, 50 / k, steps, topics.TOLERANCE)
        assert len(fit.bounds) == len(bounds) and np.allclose(fit.bounds, bounds, rtol=1e-9)
        assert all(b > a for a, b in zip(fit.bounds[1:], fit.bounds[2:]))
        assert math.isclose(fit.alpha, alpha, rel_tol=1e-6)
        got = {(r.term, r.topic): r.beta for r in fit.beta.collect()}
        assert len(got) == k * len(terms)
        for t, i in terms.items():
            for j in range(k):
                assert math.isclose(got[t, j + 1], beta[i, j], rel_tol=1e-5, abs_tol=1e-12)


def test_planted_topics_are_found_and_the_cluster_does_not_matter(spark):
    rng = np.random.default_rng(0)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = []
    for d in range(60):
        own, other = (a, b) if d % 2 else (b, a)
        for w in rng.choice(own, 80).tolist() + rng.choice(other, 4).tolist():
            rows.append((d, w, 1))
    rows += [(None, "a1", 3), (3, None, 2)]
    df = spark.createDataFrame(rows, "doc int, term string, n int").groupBy("doc", "term").sum("n").toDF("doc", "term", "n")
    df = df.withColumn("n", df["n"].cast("int"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    # (the bound is flat until the topics part)
    one = topics.fit_vem(df, k=2, block_counts=100_000, tolerance=1e-6)
    two = topics.fit_vem(df.repartition(3, "term"), k=2, block_counts=900, tolerance=1e-6, max_iter=6)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    part = topics.fit_vem(df, k=2, block_counts=100_000, tolerance=1e-6, max_iter=6)
    first, second, third = ({(r.topic, r.term): r.beta for r in m.beta.collect()} for m in (one, two, part))
    assert third.keys() == second.keys() and all(math.isclose(third[x], second[x], rel_tol=1e-6, abs_tol=1e-12) for x in third)
    mass = [sum(first[j, t] for t in a) for j in (1, 2)]
    assert min(mass) < 0.1 and max(mass) > 0.9
    assert topics.fit_vem(df.limit(0)).beta.count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("topics_")]


def test_iterations_move_no_documents(spark):
    df = spark.createDataFrame([(d, f"w{d % 7}", 1 + d % 3) for d in range(50)], "doc int, term string, n int")
    blocks = (df.selectExpr("doc % 4 as block", "doc", "xxhash64(term) as id", "n").selectExpr("cast(block as bigint) block", "doc", "id", "n")
              .groupBy("block").applyInArrow(topics._pack, "block bigint, ids array<bigint>, idx binary, n binary, ptr binary"))
    path = topics.shared_path(spark, "plan")
    blocks.write.bucketBy(4, "block").option("path", path).format("parquet").saveAsTable("plan_blocks")
    try:
        t = spark.table("plan_blocks")
        rows = t.selectExpr("block + 0 as of", "posexplode(ids) as (local, id)").selectExpr("*", "1.0D as s0", "2.0D as s1")
        plan = topics._expected(t, rows, ["s0", "s1"], [1.0, 1.0], 0.5)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange" not in plan
    finally:
        spark.sql("DROP TABLE plan_blocks")


def test_log_ratio_equals_sql_on_the_written_betas(spark, tmp_path):
    beta = QUERIES["m4_topic_beta"](spark, SF001)
    path = f"{tmp_path}/beta"
    beta.write.parquet(path)
    sql = f"""SELECT term, topic1, topic2, log2(topic2 / topic1) AS log_ratio FROM (
        SELECT term, max(beta) FILTER (topic = 1) AS topic1, max(beta) FILTER (topic = 2) AS topic2
        FROM '{path}/*.parquet' GROUP BY term)
        WHERE topic1 > {topics.TOPIC1_LIMIT} OR topic2 > {topics.TOPIC2_LIMIT}"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = {r.term: (r.topic1, r.topic2, r.log_ratio) for r in topics.topic_log_ratio(spark.read.parquet(path)).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(g[:2] == want[t][:2] and math.isclose(g[2], want[t][2], rel_tol=1e-12, abs_tol=1e-12) for t, g in got.items())


def test_iterations_send_weights_to_places_only(spark):
    # two blocks share a term: a term's row of places is opened behind the join, without its id
    counts = spark.createDataFrame([(0, 1, 11, 2), (0, 1, 12, 1), (1, 2, 12, 3), (1, 3, 13, 1)],
                                   "block long, doc long, id long, n int")
    blocks = counts.groupBy("block").applyInArrow(
        topics._pack, "block bigint, ids array<bigint>, idx binary, n binary, ptr binary").cache()
    rows = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 2.0, 1.0), (1, 0, 2.0, 1.0), (1, 1, 1.0, 1.0)],
                                 "of long, local int, s0 double, s1 double")
    got = topics._expected(blocks, rows, ["s0", "s1"], [4.0, 4.0], 0.5).collect()
    by_id = {}
    for r in got:
        by_id[r.id] = by_id.get(r.id, 0) + r.s0 + r.s1
    assert {i: round(v, 9) for i, v in by_id.items()} == {11: 2, 12: 4, 13: 1, None: 7}
    assert sum(r.docs for r in got) == 3
