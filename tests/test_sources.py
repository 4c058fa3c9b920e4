"""Sources: CSV round trip, file catalog, nested collections, corpus items, lines."""

from pyspark.sql import functions as F

from fixture_paths import SF001
from wordloom.operators.reshape import lift
from wordloom.sources.tables import (corpus_item, file_catalog, flatten, lines, nest, read_csv,
                                     read_table)


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 5, "North", 'said "great",\nthen left'), (2, 3, "South", "ok")]
    schema = "Review_ID int, Rating int, Branch string, text string"
    df = spark.createDataFrame(rows, schema)
    out = str(tmp_path / "reviews")
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(out)
    back = read_csv(spark, out, schema)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_file_catalog_lists_without_bodies(spark):
    cat = file_catalog(spark, SF001, "*.parquet")
    names = {r.name for r in cat.collect()}
    assert {"documents.parquet", "pages.parquet"} <= names
    assert "content" not in cat.columns and cat.where(F.col("length") <= 0).count() == 0


def test_nest_flatten_round_trip_and_lift(spark):
    conv = read_table(spark, SF001, "conversations")
    nested = nest(conv, "conv_id", "reviews", ["turn", "role", "text"])
    flat = flatten(nested, "reviews")
    assert sorted(map(tuple, flat.select("conv_id", "turn", "role", "text").collect())) == \
        sorted(map(tuple, conv.select("conv_id", "turn", "role", "text").collect()))
    s = spark.createDataFrame([(1, ("Spain", (1.0, 2.0)))],
                              "id int, address struct<country:string, location:struct<x:double, y:double>>")
    assert lift(s, "address.country", "country").collect()[0].country == "Spain"


def test_corpus_item_and_lines(spark):
    docs = read_table(spark, SF001, "documents")
    first = [r.doc_id for r in docs.orderBy("doc_id").limit(7).collect()][-1]
    got = corpus_item(docs, "doc_id", 7, ["doc_id"]).collect()
    assert [(r.idx, r.doc_id) for r in got] == [(7, first)]
    df = spark.createDataFrame([(1, "a\nb\n")], "id int, text string")
    assert [(r.line, r.text) for r in lines(df).collect()] == [(1, "a"), (2, "b"), (3, "")]


def test_nest_with_buckets_bounds_rows(spark):
    df = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("turn"))
    nested = nest(df, "k", "items", ["turn"], bucket=F.floor(F.col("turn") / 4))
    assert sorted(len(r.items) for r in nested.collect()) == [2, 4, 4]
    assert sorted(r.turn for r in flatten(nested, "items").collect()) == list(range(10))
