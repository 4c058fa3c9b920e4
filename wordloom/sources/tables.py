"""Table sources: parquet/CSV/JSON readers, nested review collections,
file catalogs, corpus look-ups and line splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_path

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out for CPU-heavy per-row work (tokenising): hash-partitioned on
    ``keys`` into ``spark.sql.shuffle.partitions`` partitions, at every size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             infer_from: float = 1.0) -> DataFrame:
    """Header CSV with quoted multi-line fields.

    With ``schema`` the file is read once.  Without it column types are inferred
    first, from all rows or from a share ``infer_from`` of them.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is None:
        return reader.option("inferSchema", True).option("samplingRatio", infer_from).csv(path)
    return reader.schema(schema).csv(path)


#: rows of a CSV file; a file with line ends inside texts is read by one task
CSV_ROWS = 2000


def write_csv(df: DataFrame, path: str, rows_per_file: int = CSV_ROWS) -> None:
    """The layout that ``read_csv`` reads: header, quoted texts, doubled quotes.

    A task starts a new file after ``rows_per_file`` rows, however much it
    writes, since readers cannot split files with multi-line fields."""
    (df.write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("maxRecordsPerFile", rows_per_file).csv(path))


def literal_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """``(line, text)`` table from a list of strings, ``line`` counted from 1."""
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(lines)], "line int, text string")


def nest(df: DataFrame, key: str, field: str, cols: list[str], bucket=None) -> DataFrame:
    """Nested collection: rows per ``key`` gathered into a list-of-struct
    column ``field``.

    ``bucket`` (a column expression) splits a key's rows over several nested
    rows (the bucket pattern of document stores), so one hot key never becomes
    one unbounded row; ``flatten`` reads either layout.
    """
    keys = [key] if bucket is None else [key, bucket.alias("bucket")]
    out = df.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias(field))
    return out if bucket is None else out.drop("bucket")


def flatten(df: DataFrame, field: str, keep: list[str] | None = None,
            fields: list[str] | None = None) -> DataFrame:
    """List-of-struct column to one row per element, keys kept.  With ``fields``
    only those parts of the elements are read (nested column pruning)."""
    keep = keep if keep is not None else [c for c in df.columns if c != field]
    if fields is None:
        return df.select(*keep, F.inline(field))
    if len(fields) == 1:
        return df.select(*keep, F.explode(F.col(f"{field}.{fields[0]}")).alias(fields[0]))
    return df.select(*keep, F.inline(F.arrays_zip(*[F.col(f"{field}.{f}") for f in fields])))


def written_nested(df: DataFrame, key: str, field: str, cols: list[str], bucket=None) -> DataFrame:
    """``nest`` written to the shared folder and read back: a stored collection
    whose readers fetch only the parts they name."""
    path = shared_path(df.sparkSession, "nested")
    rows = nest(df, key, field, cols, bucket)
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def file_catalog(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Directory listing: ``(path, name, length, modificationTime)`` without file bodies."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
             .select("path", "length", "modificationTime"))
    return files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def corpus_item(df: DataFrame, order_col: str, i: int, cols: list[str]) -> DataFrame:
    """The ``i``-th row (1-based) of a corpus ordered by ``order_col``.

    Any ``i`` costs the same: rows are numbered by ``numbered``, and no task
    holds the first ``i`` of them.
    """
    rows = numbered(df.select(*dict.fromkeys([order_col, *cols])), order_col, name="_idx")
    return rows.where(F.col("_idx") == i).select(F.col("_idx").cast("int").alias("idx"), *cols)


def numbered(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """``df`` with the place (from 1, nulls first) of every row in a global order.

    Rows are dealt by ranges of the order and sorted inside each range; a
    row's place is its place there plus the sizes of the ranges before, one row
    a range.  The ranges are written to the shared folder once, as a second
    look could cut them elsewhere.  Ties get different places in any order; name
    enough columns to avoid that.
    """
    spark = df.sparkSession
    path = shared_path(spark, "numbered")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    ranges.write.parquet(path)
    rows = spark.read.schema(ranges.schema).parquet(path)
    part = F.shiftright("_at", 33)  # number of the range; the low bits count its rows
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (rows.withColumn("_part", part).join(starts, "_part")
            .select(*df.columns, place.cast("bigint").alias(name)))


def lines(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per text line: ``(…keep, line, text)`` with ``line`` counted from 1."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    return (df.select(*keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("line", text_col))
            .withColumn("line", (F.col("line") + 1).cast("bigint")))
