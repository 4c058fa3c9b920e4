"""Operator 11: ranked lexical search, accumulator-limited term-at-a-time.

The best documents of every item by a sum of whole-number term scores:
``w * ((10^9 tf) div (1000 tf + 8 m))`` over the item's distinct terms, with
``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and ``m = 10 + (90 n N) div L``.

Documents are searched where they are read; no posting is shuffled.  One pass
counts N, L and the df of the items' terms.  In a second pass every task
inverts its documents in chunks of a bounded size and goes through an item's
terms, rarest in the corpus first:

* a posting adds to its document's accumulator, or makes one;
* before each term the bound of what is left (the sum of the highest scores
  of the remaining terms in the chunk) is held against the kth best partial
  score and against the kth best final score of the chunks before; once it
  is below, no document without an accumulator can come in, and none is made
  any more;
* survivors get the remaining terms exactly.

A task keeps the best rows over its chunks, and Spark merges the tasks' rows
(a limit per group before the shuffle).  Items go to the tasks in blocks of a
checked size; every block is one more pass over the documents.

Terms are maximal runs of ASCII letters, digits and all characters beyond
ASCII; only A-Z is lower-cased.  Defined results: a null or empty text has no
term and never ranks, an item without one gives no rows; equal scores go by
ascending doc_id, a null doc_id last; rows that share a doc_id are documents
of their own; items are told apart by id and text, and rows equal in both are
one item; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: terms of the documents that are inverted together, about
CHUNK_TERMS = 4_000_000
#: bytes of the item texts that are sent to the tasks together, about
BLOCK_BYTES = 4_000_000
#: bytes of a text that are split at a time
PART = 4_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def terms(text: str | None):
    """The terms of a text in lists, part by part."""
    raw, at = (text or "").encode().translate(_TABLE), 0
    while at < len(raw):
        end = raw.find(b" ", at + PART)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Items:
    """Items of a block: distinct terms (numbered from 1) of each."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.number, self.words = rows, {}, []
        for _, _, text in rows:
            found = {t for part in terms(text) for t in part}
            self.words.append([self.number.setdefault(t, len(self.number) + 1) for t in sorted(found)])


def corpus_counts(docs: DataFrame, items) -> tuple[int, int, dict[bytes, int]]:
    """N, L and the df of the block's terms, from one pass."""
    def count(batches):
        number = items.value.number
        n_docs = n_terms = 0
        df = np.zeros(len(number) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n, found = 0, set()
                for part in terms(text.as_py()):
                    n += len(part)
                    found.update(filter(None, map(number.get, part)))
                if n:
                    n_docs += 1
                    n_terms += n
                    df[list(found)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([-1, -2], at)), pa.int64()),
             pa.array(np.concatenate(([n_docs, n_terms], df[at])), pa.int64())], names=["id", "c"])

    rows = docs.select("text").mapInArrow(count, "id bigint, c bigint").groupBy("id").agg(F.sum("c").alias("c"))
    got = {r.id: r.c for r in rows.collect()}  # one row a term of the block
    return got.pop(-1, 0), got.pop(-2, 0), got


class Chunk:
    """Postings of some documents for the terms of the items, with scores."""

    def __init__(self, size: int):
        self.size, self.ids, self.lengths, self.hits = size, [], [], []

    def add(self, doc_id, n: int, hits: np.ndarray) -> None:
        self.hits.append(hits + len(self.ids) * self.size)
        self.ids.append(doc_id)
        self.lengths.append(n)

    def invert(self, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        key, tf = np.unique(np.concatenate(self.hits), return_counts=True)
        doc, term = np.divmod(key, self.size)
        m = np.array([10 + 90 * n * n_docs // n_terms for n in self.lengths], np.int64)
        score = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.score = doc[order], score[order]
        self.start = np.searchsorted(term[order], np.arange(self.size + 1))
        self.best = [int(self.score[a:b].max()) if b > a else 0 for a, b in zip(self.start, self.start[1:])]
        self.total = np.zeros(len(self.ids), np.int64)
        self.made = np.zeros(len(self.ids), bool)

    def search(self, words: list[int], k: int, least: int) -> list[tuple[int, int]]:
        """(score, document) of those that may be among the k best, given that
        ``least`` is the kth best score of other documents; ``words`` rarest first."""
        total, made = self.total, self.made
        left = list(accumulate((self.best[w] for w in reversed(words)), initial=0))[::-1]
        touched, n_made, closed = [], 0, False
        for w, bound in zip(words, left):
            a, b = self.start[w], self.start[w + 1]
            if not closed:
                kth = least
                if n_made >= k:
                    have = total[np.concatenate(touched)]
                    kth = max(kth, int(np.partition(have, len(have) - k)[len(have) - k]))
                closed = bound < kth
            docs, score = self.doc[a:b], self.score[a:b]
            if closed:
                mine = made[docs]
                docs, score = docs[mine], score[mine]
            else:
                new = docs[~made[docs]]
                made[new] = True
                n_made += len(new)
                touched.append(new)
            total[docs] += score
        found = np.concatenate(touched) if touched else np.zeros(0, np.int64)
        scores = total[found]
        total[found] = 0
        made[found] = False
        kth = max(least, 1)
        if len(scores) > k:
            kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        good = np.flatnonzero(scores >= kth)
        return list(zip(scores[good].tolist(), found[good].tolist()))


def _order(row: tuple) -> tuple:
    return -row[0], row[1] is None, row[1] or 0


def _search_block(docs: DataFrame, rows: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    items = spark.sparkContext.broadcast(Items(rows))  # a block: of a checked size
    n_docs, n_terms, df = corpus_counts(docs, items)
    size = len(items.value.number) + 1
    weights = np.zeros(size, np.int64)
    for t, c in df.items():
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1)))
    queries = [sorted((t for t in words if t in df), key=lambda t: (df[t], t)) for words in items.value.words]

    def search(batches):
        number = items.value.number
        best: list[list[tuple]] = [[] for _ in queries]

        def close(chunk):
            chunk.invert(weights, n_docs, n_terms)
            for q, words in enumerate(queries):
                least = best[q][-1][0] if len(best[q]) == k else 0
                found = chunk.search(words, k, least)
                if found:
                    best[q] = sorted(best[q] + [(s, chunk.ids[d]) for s, d in found], key=_order)[:k]

        chunk, held = Chunk(size), 0
        for batch in batches:
            for doc_id, text in zip(*(batch.column(i) for i in (0, 1))):
                n, hits = 0, []
                for part in terms(text.as_py()):
                    n += len(part)
                    ids = list(filter(None, map(number.get, part)))
                    hits.append(np.array(ids, np.int64))
                hits = np.concatenate(hits) if hits else np.zeros(0, np.int64)
                if len(hits):
                    chunk.add(doc_id.as_py(), n, hits)
                    held += len(hits)
                if held > CHUNK_TERMS:
                    close(chunk)
                    chunk, held = Chunk(size), 0
        if held:
            close(chunk)
        flat = [(q, s, d) for q, rows in enumerate(best) for s, d in rows]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.int64()),
                                          pa.array([f[2] for f in flat], pa.int64())], names=["q", "score", "doc_id"])

    found = docs.select("doc_id", "text").mapInArrow(search, "q int, score bigint, doc_id bigint")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top, rows


def item_blocks(items: DataFrame, max_bytes: int = BLOCK_BYTES):
    """Blocks of (number, item_id, text): hashed, and halved until a block is of
    at most ``max_bytes`` or holds one item."""
    items = items.distinct().withColumn("b", F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(100))
    parts = 1
    hashed = F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 40))
    while True:
        block = F.pmod(hashed, F.lit(parts))
        sizes = items.groupBy(block.alias("block")).agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("c"))
        sizes = sizes.agg(F.max(F.when(F.col("c") > 1, F.col("b")))).first()[0] or 0
        if sizes <= max_bytes:
            break
        parts *= 2
    for i in range(parts):
        rows = items.where(block == i).select("item_id", "text").orderBy("item_id", "text").collect()
        if rows:
            yield [(q, r.item_id, r.text) for q, r in enumerate(rows)]


def search(docs: DataFrame, items: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id",
           item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item
    with a score above 0, over all documents."""
    spark = docs.sparkSession
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"),
                       docs[f"`{text_col}`"].cast("string").alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    items = items.select(items[f"`{item_id}`"].alias("item_id"), items[f"`{item_text}`"].cast("string").alias("text"))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for rows in item_blocks(items):
        top, rows = _search_block(docs, rows, k)
        names = spark.createDataFrame([r[:2] for r in rows], f"q int, item_id {kind}")
        out = out.union(top.join(names, "q").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
size AS (SELECT count(*) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM docs WHERE len(t) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM docs) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), size),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
m AS (SELECT r, doc_id, 10 + (90 * CAST(len(t) AS BIGINT) * big_n) // big_l AS m FROM docs, size WHERE len(t) > 0),
score AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
          FROM item JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score JOIN docs USING (r) WHERE score > 0 QUALIFY rank <= 10
"""
