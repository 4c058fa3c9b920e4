"""Operator 1: exact top-k search by term-at-a-time accumulation.

A vector is a sparse row of integer weights (floor(256 * x) of each component;
a component is a term).  Candidates and queries are dealt into blocks by hash;
every query block meets every candidate block in one task.  There the block's
postings are built term by term, each query scatters its weight times the
posting weights into a dense score array over the block, the k best of each
array are selected by partition, and the blocks' winners are merged by a
group-limited window.  Blocks have a bounded number of rows, so a hot vector
(ties) only makes ties, and nothing goes through the driver.

The work is queries x rows by the definition of an exhaustive search; the
query set is stated by the caller, and it is the queries that are sent to the
candidate blocks.

Defined results: a vector that is null, or has a null or non-finite
component, and a row without an id take no part; vectors of unequal length
share the terms they both have; a query's own id never answers it; repeated
candidate rows count each, a repeated query row is asked once; ties go to the
smaller id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a candidate block: at least, at most, and blocks to aim for between
MIN_BLOCK, MAX_BLOCK, BLOCKS = 2048, 131_072, 48
QUERY_BLOCK = 16_384
#: scores accumulated at once
CELLS = 1 << 18


def weights(vec: Column, scale: float = 256.0) -> Column:
    """Integer weights of a vector; null if it cannot take part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vec.isNotNull() & ~bad,
                  F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _postings(flat: np.ndarray, ends: np.ndarray):
    """term -> (rows, weights) of the non-zero weights, rows ascending."""
    sizes = np.diff(ends)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
    keep = np.flatnonzero(flat)
    keep = keep[np.argsort(terms[keep], kind="stable")]
    terms, rows, flat = terms[keep], rows[keep], flat[keep]
    cuts = np.flatnonzero(np.diff(terms)) + 1
    return {int(t[0]): (r, w) for t, r, w in zip(
        np.split(terms, cuts), np.split(rows, cuts), np.split(flat, cuts)) if len(t)}


def _accumulate(q_postings, n_queries: int, c_postings, n_rows: int) -> np.ndarray:
    """Dense scores of some queries over the block, one term at a time."""
    scores = np.zeros((n_queries, n_rows), np.int64)
    for term, (q_rows, q_weights) in q_postings.items():
        if term not in c_postings:
            continue
        rows, w = c_postings[term]
        added = q_weights[:, None] * w[None, :]
        if len(q_rows) == n_queries and len(rows) == n_rows:
            scores += added
        else:
            scores[np.ix_(q_rows, rows)] += added
    return scores


def _select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Rows of the k best scores, own id left out; ``ids`` ascend."""
    open_rows = np.flatnonzero(ids != own)
    s = scores[open_rows]
    if len(s) > k:
        border = np.partition(s, len(s) - k)[len(s) - k]
        better, equal = np.flatnonzero(s > border), np.flatnonzero(s == border)
        pick = np.concatenate([better, equal[:k - len(better)]])
    else:
        pick = np.arange(len(s))
    return open_rows[pick]


def _search_block(cands: pa.Table, queries: pa.Table, k: int, out_schema: pa.Schema) -> pa.Table:
    def unpack(table):
        table = table.combine_chunks()
        lists = table.column("w").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
        ends = lists.offsets.to_numpy().astype(np.int64)
        return (table.column("vec_id").to_numpy(), lists.values.to_numpy()[ends[0]:ends[-1]], ends - ends[0])

    parts = []
    if len(cands) and len(queries):
        ids, flat, ends = unpack(cands.sort_by("vec_id"))
        c_postings = _postings(flat, ends)
        q_ids, q_flat, q_ends = unpack(queries)
        q_keys = queries.column("query_key").to_numpy()
        step = max(1, CELLS // len(ids))
        for a in range(0, len(q_ids), step):
            b = min(a + step, len(q_ids))
            scores = _accumulate(_postings(q_flat[q_ends[a]:q_ends[b]], q_ends[a:b + 1]), b - a,
                                 c_postings, len(ids))
            for i in range(a, b):
                pick = _select(scores[i - a], ids, q_ids[i], k)
                parts.append((np.full(len(pick), q_ids[i]), np.full(len(pick), q_keys[i]),
                              ids[pick], scores[i - a][pick]))
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.array([], np.int64)] * 4
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=out_schema)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for every query row."""
    n = max(1, df.count())
    c_blocks = math.ceil(n / min(MAX_BLOCK, max(MIN_BLOCK, math.ceil(n / BLOCKS))))
    rows = (df.select(F.col(id_col).cast("long").alias("vec_id"), weights(F.col(vec_col)).alias("w"),
                      is_query.alias("asks"))
            .where(F.col("vec_id").isNotNull() & F.col("w").isNotNull()))
    asked = (rows.where("asks").select("vec_id", "w", F.xxhash64("w").alias("query_key"))
             .dropDuplicates(["vec_id", "query_key"]))
    q_blocks = math.ceil(max(1, rows.where("asks").count()) / QUERY_BLOCK)

    def dealt(d, own, n_own, other, n_other):
        mine = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(n_own)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return d.select(*d.columns, mine, every)

    cands = dealt(rows.select("vec_id", "w"), "c_block", c_blocks, "q_block", q_blocks)
    queries = dealt(asked, "q_block", q_blocks, "c_block", c_blocks)
    out = pa.schema([(c, pa.int64()) for c in ("query_id", "query_key", "vec_id", "score")])
    found = (cands.groupBy("c_block", "q_block").cogroup(queries.groupBy("c_block", "q_block"))
             .applyInArrow(lambda c, q: _search_block(c, q, k, out),
                           "query_id long, query_key long, vec_id long, score long"))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
