"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing (local tests) the warehouse folder is used,
    which every executor can reach as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The files cut the lineage, survive lost executors and keep column pruning
    for every later reader.  They are removed when the driver ends, or by the
    caller that gathers their paths (``gathering``).
    """
    path = table_path(df.sparkSession, name)
    if (paths := _paths.get()) is not None:
        paths.append(path)
    return written(df, path)


_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)


@contextmanager
def gathering(paths: list[str]):
    """Paths of the tables that ``stash`` writes inside the block go to ``paths``."""
    token = _paths.set(paths)
    try:
        yield paths
    finally:
        _paths.reset(token)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{scratch_dir(spark)}/wordloom-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    if SparkContext._active_spark_context is spark.sparkContext:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def quoted(name: str) -> str:
    """A column name for ``F.col``, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where ``df`` has columns called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
