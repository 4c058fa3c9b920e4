"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with an edge; the root is the smallest node.

    Alternates large-star and small-star steps: every node sends its larger
    neighbours, then its smaller ones, to its smallest neighbour.  A hub is
    never gathered: minima are aggregated before the shuffle and joined back
    by an equi-join that Spark may split.  Rounds grow with the logarithm of
    the component size; each is written to the shared folder.
    """
    def distinct(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                            F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    now = stash(distinct(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    seen = state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = distinct(both.join(low, "a").where("b > a").select(F.col("b").alias("a"),
                                                                   F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stash(distinct(small.union(low.select("a", F.col("m").alias("b")))), "edges")
        before, seen = seen, state(now)
        if before == seen:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))
