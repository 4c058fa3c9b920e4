"""TF-IDF and the correlation test.

TF-IDF: per-document totals and per-term document frequencies are two
aggregates joined back to the count table; the number of documents is a
scalar subquery (run once, inlined as a literal), so nothing is broadcast
whose size is not one row and no window spans a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import p_value_col

# Fixed value: 97.5 % quantile of the standard normal (95 % interval).
Z_975 = 1.959963984540054


def tf_idf(counts: DataFrame, term: str, doc: str, n: str = "n", total: str | None = None) -> DataFrame:
    """Add ``tf = n / sum(n) per doc``, ``idf = ln(N_docs / docs_with_term)``
    and ``tf_idf = tf * idf`` to a ``(doc, term, n)`` count table.

    The three uses of ``counts`` (row side, totals, document frequencies) are
    the same subtree joined null-safely, so Spark computes it once and reuses
    its shuffle output (``ReusedExchange``) instead of re-reading the input.
    ``total`` (optional) also keeps the per-document total under that name.
    """
    tot = counts.groupBy(doc).agg(F.sum(n).alias("_total"))
    dfreq = counts.groupBy(term).agg(F.count(n).alias("_df"))  # uses n: keeps the shared subtree
    n_docs = tot.select(F.count("_total")).scalar()
    out = (counts.join(tot, counts[doc].eqNullSafe(tot[doc]), "left").drop(tot[doc])
           .join(dfreq, counts[term].eqNullSafe(dfreq[term]), "left").drop(dfreq[term]))
    tf = F.col(n).cast("double") / F.col("_total").cast("double")
    idf = F.ln(n_docs.cast("double") / F.col("_df").cast("double"))
    out = (out.withColumn("tf", tf).withColumn("idf", idf)
           .withColumn("tf_idf", F.col("tf") * F.col("idf")))
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop("_total", "_df")


def cor_test(df: DataFrame, x: str, y: str, group: list[str] | None = None,
             p_value: bool = True) -> DataFrame:
    """Pearson correlation test per group on complete (x, y) pairs.

    Columns: ``estimate`` (r), ``n``, ``statistic`` (t), ``df`` (n-2),
    ``conf_low``/``conf_high`` (95 % Fisher-z interval) and, when asked,
    ``p_value`` (two-sided).  All but the p-value are Spark aggregates; the
    p-value runs on the aggregated rows.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    agg = (df.groupBy(*(group or []))
           .agg(F.corr(x, y).alias("estimate"),
                F.count(F.when(both, F.lit(1))).alias("n")))
    r = F.col("estimate")
    nn = F.col("n").cast("double")
    t = F.try_divide(r * F.sqrt(nn - 2), F.sqrt(F.lit(1.0) - r * r))
    se = F.try_divide(F.lit(Z_975), F.sqrt(nn - 3))
    out = (agg.withColumn("statistic", t)
           .withColumn("df", (F.col("n") - 2).cast("bigint"))
           .withColumn("conf_low", F.tanh(F.atanh(r) - se))
           .withColumn("conf_high", F.tanh(F.atanh(r) + se)))
    if p_value:
        out = out.withColumn("p_value", p_value_col(F.col("statistic"), F.col("df").cast("double")))
    return out


def log_ratio(a: str, b: str) -> F.Column:
    """``log2(a / b)``; null when the ratio is undefined."""
    ratio = F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return F.when(ratio > 0, F.log2(ratio))

