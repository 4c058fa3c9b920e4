"""Column reshaping, unions, pivots and joins by shared names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename_at(df: DataFrame, i: int, name: str) -> DataFrame:
    """Rename the ``i``-th column (1-based)."""
    return df.withColumnRenamed(df.columns[i - 1], name)


def drop_at(df: DataFrame, positions: list[int]) -> DataFrame:
    """Drop columns by 1-based position."""
    gone = {p - 1 for p in positions}
    return df.select(*[c for i, c in enumerate(df.columns) if i not in gone])


def lift(df: DataFrame, path: str, name: str) -> DataFrame:
    """Copy a nested field (``address.country``) to a top-level column."""
    return df.withColumn(name, F.col(path))


def tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """Union all by column name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two sides share."""
    keys = sorted(set(left.columns) & set(right.columns))
    if not keys:
        raise ValueError("no shared columns to join on")
    return left.join(right, keys, how)


def spread(df: DataFrame, key: str, value: str, values: list[str]) -> DataFrame:
    """Long to wide: one column per listed ``key`` value holding ``value``.

    The value list is always given, so no extra job is run to discover it.
    """
    rest = [c for c in df.columns if c not in (key, value)]
    return df.groupBy(*rest).pivot(key, values).agg(F.first(value))


def gather(df: DataFrame, key: str, value: str, cols: list[str]) -> DataFrame:
    """Wide to long over ``cols``; other columns are kept, null values kept."""
    ids = [c for c in df.columns if c not in cols]
    return df.unpivot(ids, cols, key, value)
