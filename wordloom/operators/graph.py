"""Directed word graphs as two tables: ``edges(from, to, …)`` and ``vertices(name)``.

``group`` names the columns that tell several graphs in one table apart (one
graph per group, all built by the same jobs); without it there is one graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ends(edges: DataFrame, group: list[str]) -> DataFrame:
    return (edges.select(*group, F.col("from").alias("name"))
            .union(edges.select(*group, F.col("to").alias("name"))))


def graph_from_edges(df: DataFrame, src: str = "word1", dst: str = "word2",
                     group: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``src`` and ``dst`` become the edge ends (``from``/``to``), the rest edge
    attributes; vertices are the distinct names on either end."""
    group = list(group or [])
    attrs = [c for c in df.columns if c not in (src, dst, *group)]
    edges = df.select(*group, F.col(src).alias("from"), F.col(dst).alias("to"), *attrs)
    return edges, _ends(edges, group).distinct()


def degrees(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per vertex: ``out_degree`` and ``in_degree`` (0 when absent)."""
    group = list(group or [])
    out = edges.select(*group, F.col("from").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select(*group, F.col("to").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.union(into).groupBy(*group, "name").agg(F.sum("o").alias("out_degree"),
                                                       F.sum("i").alias("in_degree"))


def summary(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Number of vertices and edges, per graph (one row without ``group``)."""
    group = list(group or [])
    # every vertex once with the edges that leave it: both numbers in one pass
    per_vertex = degrees(edges, group)
    return per_vertex.groupBy(*group).agg(F.count(F.lit(1)).alias("vertices"),
                                          F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"))
