"""Topic models by variational expectation maximisation, topic-term betas in
long form, and the two-topic comparison (spread, filter, log ratio).

The model is latent Dirichlet allocation with one estimated symmetric alpha.
Nothing of the size of the vocabulary or of the corpus is on the driver:

* documents are packed once into blocks of term counts, a table bucketed by
  block, so no iteration moves documents;
* the topic-term weights are a table of one row a term, and so are the places
  of the terms in the blocks, a table bucketed by term.  Each iteration joins
  the two and sends a term's weights to its places, every block gets the rows of its own
  terms, infers its documents in numpy, and returns weights by term, which are
  added up into the next table;
* only sums per topic, the bound and alpha's statistic (a few numbers) come to
  the driver, which updates alpha and decides when to stop.

Start weights are hashes of seed, topic and term, so a fit depends on neither
the cluster nor the order of rows (but for the order of floating-point sums).
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import label, tokens
from ..session import remove_path, shared_path
from .reshape import spread
from .stats import log_ratio

#: term counts of a block of documents, on average
BLOCK_COUNTS = 150_000
#: limits of the inference of a document and of the fit, as relative changes of the bound
DOC_TOLERANCE, DOC_STEPS = 1e-6, 500
TOLERANCE, STEPS = 1e-4, 1000


def token_arrays(df: DataFrame, key: str, text: str = "text", drop: list[str] | None = None) -> DataFrame:
    """``(key, words)``: the token array of each text, listed words removed."""
    toks = tokens(text)
    if drop:
        words = list(drop)
        toks = F.filter(toks, lambda w: ~w.isin(words))
    return df.select(key, toks.alias("words"))


def term_counts(arrays: DataFrame, key: str) -> DataFrame:
    """``(doc, term, n)`` of token arrays."""
    return (arrays.select(F.col(key).alias("doc"), F.explode("words").alias("term"))
            .groupBy("doc", "term").agg(F.count(F.lit(1)).cast("int").alias("n")))


# -- numeric helpers -----------------------------------------------------------

def digamma(x):
    """Derivative of log gamma for positive x (shifted asymptotic series)."""
    x = np.asarray(x, dtype=np.float64)
    low = sum(1.0 / (x + j) for j in range(7))
    y = x + 7
    r = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - low


def trigamma(x):
    x = np.asarray(x, dtype=np.float64)
    low = sum(1.0 / (x + j) ** 2 for j in range(7))
    y = x + 7
    r = 1.0 / (y * y)
    return 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30))) + low


def log_gamma(x):
    x = np.asarray(x, dtype=np.float64)
    low = np.log(np.prod([x + j for j in range(7)], axis=0))
    y = x + 7
    r = 1.0 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y - low


def best_alpha(n_docs: float, statistic: float, k: int) -> float:
    """The symmetric alpha that maximises the bound (Newton steps on its logarithm);
    ``statistic`` sums ``E[log theta]`` over documents and topics."""
    start = log_a = math.log(100.0)
    for _ in range(200):
        a = math.exp(log_a)
        if not math.isfinite(a) or a <= 0:
            start -= math.log(10.0)
            log_a = start
            continue
        slope = n_docs * k * float(digamma(k * a) - digamma(a)) + statistic
        curve = n_docs * k * float(k * trigamma(k * a) - trigamma(a))
        step = slope / (curve * a + slope)
        log_a -= step
        if abs(slope) <= 1e-5:
            break
    return math.exp(log_a)


def infer(log_beta: np.ndarray, idx: np.ndarray, n: np.ndarray, ptr: np.ndarray, alpha: float):
    """Variational inference of documents given as term numbers ``idx``, counts
    ``n`` and starts ``ptr``: weights by term, the sum of the bounds and the
    sum of ``E[log theta]``.

    All documents step together; one that has converged leaves.  Term counts are
    held as one array a topic, which is several times faster than rows of k."""
    n_terms, k = log_beta.shape
    weights = np.zeros((n_terms, k))
    size = np.diff(ptr)
    total = np.add.reduceat(n, ptr[:-1]) if len(size) else np.zeros(0)
    fixed = float(log_gamma(k * alpha) - k * log_gamma(alpha))
    bound_sum = statistic = 0.0
    beta = np.exp(log_beta)
    weight, counts, words = [beta[:, j].take(idx) for j in range(k)], n.astype(np.float64), idx
    gamma = np.repeat((alpha + total / k)[:, None], k, axis=1)
    before = np.full(len(size), -np.inf)
    live = np.arange(len(size))
    for step in range(DOC_STEPS):
        dig = digamma(gamma)
        top = dig.max(axis=1)
        theta = np.exp(dig - top[:, None])
        phi = [weight[j] * np.repeat(theta[:, j], size) for j in range(k)]
        norm = sum(phi)
        share = counts / norm
        for p in phi:
            p *= share
        start = np.cumsum(size) - size
        gamma = alpha + np.column_stack([np.add.reduceat(p, start) for p in phi])
        new = digamma(gamma)
        both = digamma(gamma.sum(axis=1))
        rest = np.add.reduceat(counts * np.log(norm), start) + total[live] * top
        bound = (fixed - log_gamma(gamma.sum(axis=1)) + log_gamma(gamma).sum(axis=1)
                 + ((alpha - gamma) * (new - both[:, None])).sum(axis=1)
                 + ((gamma - alpha) * (new - dig)).sum(axis=1) + rest - total[live] * both)
        done = np.abs((before - bound) / np.where(np.isfinite(before), before, 1.0)) < DOC_TOLERANCE
        done |= step == DOC_STEPS - 1
        before = bound
        if not done.any():
            continue
        mine = np.repeat(done, size)
        at = words[mine]
        for j in range(k):
            weights[:, j] += np.bincount(at, phi[j][mine], n_terms)
        bound_sum += float(bound[done].sum())
        statistic += float((new[done].sum(axis=1) - k * both[done]).sum())
        stay = ~done
        if not stay.any():
            break
        left = ~mine
        weight, counts, words = [w[left] for w in weight], counts[left], words[left]
        gamma, before, live, size = gamma[stay], before[stay], live[stay], size[stay]
    return weights, bound_sum, statistic


# -- the fit ---------------------------------------------------------------------

@dataclass
class TopicModel:
    """``beta``: a written table (topic, term, beta); betas of a topic sum to 1."""

    beta: DataFrame
    alpha: float
    bounds: list[float] = field(default_factory=list)


def _pack(table: pa.Table) -> pa.Table:
    """A block of (doc, id, n) rows as one row of arrays."""
    doc = table.column("doc").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    order = np.lexsort((ids, doc))
    known, idx = np.unique(ids[order], return_inverse=True)
    ptr = np.flatnonzero(np.concatenate(([True], np.diff(doc[order]) != 0, [True])))
    raw = [a.astype(np.int32).tobytes() for a in (idx, n[order], ptr)]
    return pa.table([table.column("block").slice(0, 1), pa.array([known.tolist()], pa.list_(pa.int64())),
                     *[pa.array([r], pa.binary()) for r in raw]], names=["block", "ids", "idx", "n", "ptr"])


def fit_vem(counts: DataFrame, k: int = 2, seed: int = 123, tolerance: float = TOLERANCE, max_iter: int = STEPS,
            block_counts: int = BLOCK_COUNTS) -> TopicModel:
    """Fit ``k`` topics to ``(doc, term, n)`` counts; alpha starts at 50 / k.

    Null terms and documents take no part; an empty table gives no betas.
    """
    spark = counts.sparkSession
    base = shared_path(spark, "topics")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    s = [f"s{j}" for j in range(k)]
    counts = kept(counts.where("doc is not null and term is not null").select("doc", "term", "n"), "counts")
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    vocabulary = kept(vocabulary.select("term"), "terms")
    salt = 0
    while True:  # terms are numbered by hash; another one where two terms collide
        number = F.xxhash64(F.lit(salt), F.col("term"))
        n_terms, n_ids = vocabulary.agg(F.count("term"), F.count_distinct(number)).first()
        if n_terms == n_ids:
            break
        salt += 1
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // block_counts))
    name = "topics_" + uuid.uuid4().hex
    blocks = (counts.select(F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).alias("block"), "doc", number.alias("id"), "n")
              .groupBy("block").applyInArrow(_pack, "block bigint, ids array<bigint>, idx binary, n binary, ptr binary"))
    (blocks.write.bucketBy(min(n_blocks, 10_000), "block").option("path", f"{base}/blocks").format("parquet")
     .saveAsTable(name))
    try:
        blocks = spark.table(name)
        # one row a term, with its places: no iteration moves or sorts the terms of the blocks to join them
        (blocks.select((F.col("block") + 0).alias("of"), F.posexplode("ids").alias("local", "id"))
         .groupBy("id").agg(F.collect_list(F.struct("of", "local")).alias("at"))
         .write.bucketBy(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 10_000), "id").sortBy("id")
         .option("path", f"{base}/places").format("parquet").saveAsTable(f"{name}_places"))
        places = spark.table(f"{name}_places")

        def start(j):
            # in (0, 1), and 1 / terms more
            return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(j), F.col("term")), 11) + 0.5) / F.lit(2.0 ** 53) + 1.0 / max(n_terms, 1)
        weights = kept(vocabulary.select(number.alias("id"), *[start(j).alias(c) for j, c in enumerate(s)]), "start")
        totals = [t or 0.0 for t in weights.agg(*[F.sum(c) for c in s]).first()]
        alpha, bounds = 50.0 / k, []
        while n_terms and len(bounds) < max_iter:
            stats = _expected(blocks, places.join(weights, "id").select(F.inline("at"), *s), s, totals, alpha)
            sums = Observation()  # the few sums are gathered by the job that writes the weights
            stats = kept(stats.observe(sums, *[F.sum(F.when(F.col("id").isNull(), F.col(c))).alias(c)
                                               for c in (*s, "docs", "statistic", "bound")]), f"step-{len(bounds)}")
            row = sums.get
            totals = [row[c] for c in s]
            weights = stats.where("id is not null").groupBy("id").agg(*[F.sum(c).alias(c) for c in s])
            alpha = best_alpha(row["docs"], row["statistic"], k)
            remove_path(spark, f"{base}/step-{len(bounds) - 1}")
            bounds.append(row["bound"])
            if len(bounds) > 2 and abs((bounds[-2] - bounds[-1]) / bounds[-2]) <= tolerance:
                break
        topic = F.array(*[F.struct(F.lit(j + 1).alias("topic"), (F.col(c) / F.lit(t)).alias("beta"))
                          for j, (c, t) in enumerate(zip(s, totals))])
        beta = (vocabulary.withColumn("id", number).join(weights, "id")
                .select("term", F.inline(topic)).select("topic", "term", "beta"))
        beta = kept(beta, "beta")
    finally:
        for table in (name, f"{name}_places"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for part in ("blocks", "places", "counts", "start"):
            remove_path(spark, f"{base}/{part}")
    return TopicModel(beta, alpha, bounds)


def _expected(blocks: DataFrame, slices: DataFrame, s: list[str], totals: list[float], alpha: float) -> DataFrame:
    """Weights by block and term, and a row of sums for every block (null id)."""
    k = len(s)
    shift = np.log(np.array(totals))

    def step(mine: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["id", *s, "docs", "statistic", "bound"]
        if not mine.num_rows:
            return pa.table([pa.array([], pa.int64())] + [pa.array([], pa.float64())] * (k + 3), names=names)
        idx, n, ptr = (np.frombuffer(mine.column(c)[0].as_py(), np.int32) for c in ("idx", "n", "ptr"))
        order = np.argsort(rows.column("local").to_numpy())
        with np.errstate(divide="ignore"):
            log_beta = np.log(np.column_stack([rows.column(c).to_numpy()[order] for c in s])) - shift
        log_beta = np.maximum(log_beta, -100.0)  # a weight that underflows stays possible
        weights, bound, statistic = infer(log_beta, idx, n, ptr, alpha)
        ids = np.concatenate((mine.column("ids")[0].values.to_numpy(), [0]))
        last = np.arange(len(ids)) < len(ids) - 1
        cols = [np.concatenate((weights[:, j], [weights[:, j].sum()])) for j in range(k)]
        sums = [np.where(last, 0.0, x) for x in (len(ptr) - 1, statistic, bound)]
        return pa.table([pa.array(ids, mask=~last), *map(pa.array, cols), *map(pa.array, sums)], names=names)

    schema = "id bigint, " + ", ".join(f"{c} double" for c in (*s, "docs", "statistic", "bound"))
    return (blocks.select("block", "ids", "idx", "n", "ptr").groupBy("block")
            .cogroup(slices.select("of", "local", *s).groupBy("of")).applyInArrow(step, schema))


# Beta limits of the topic comparison (they differ per topic).
TOPIC1_LIMIT = 1e-7
TOPIC2_LIMIT = 1e-6


def topic_log_ratio(beta: DataFrame, lo1: float = TOPIC1_LIMIT, lo2: float = TOPIC2_LIMIT) -> DataFrame:
    """Terms that separate topic 1 from topic 2: ``log_ratio = log2(topic2/topic1)``
    for terms with ``topic1 > lo1`` or ``topic2 > lo2``."""
    labelled = beta.select(label("topic", "topic").alias("topic"), "term", "beta")
    wide = spread(labelled, "topic", "beta", ["topic1", "topic2"])
    return (wide.where((F.col("topic1") > lo1) | (F.col("topic2") > lo2))
            .withColumn("log_ratio", log_ratio("topic2", "topic1")))
