"""Operator 10: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed five-word shingles (64 bits); two documents are
linked if the Jaccard similarity of their sets is at least 0.8.

1. Documents with equal sets (128-bit digest) form a class; only classes are
   compared, so exact copies cost nothing.
2. MinHash values are cut into bands.  All classes that agree in a band are
   connected to the smallest of them (a star, never all pairs), and the
   connected components of these stars hold every candidate pair: a pair at
   the threshold is missed with probability (1 - 0.8^6)^40, about 5e-6.
3. Inside a component pairs are compared in blocks: MinHash values 48 at a
   time, a pair is dropped as soon as the posterior probability (uniform
   prior) that its similarity reaches the threshold falls below ``TOLERANCE``;
   what is left is verified exactly on the sets.  Pairs are never emitted:
   a task returns each class's number of links and a spanning forest.
   Components of any size are cut into blocks of bounded size.

The result has one row a document: its class (smallest doc_id of the copies),
the number of copies, the number of links of its class to other classes, and
its group (smallest doc_id of the connected component of links).

Defined results: words are separated by ASCII white space and compared as
they are; a text of one to four words is one shingle of all of them; a null
or empty text has no shingle, is a class and a group of its own and has no
links; rows that share doc_id and text are copies, rows that share only the
doc_id are compared as any others; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import quoted, stash, unused
from .sentencepiece_codec import slices

SHINGLE_WORDS = 5
#: similarity threshold as a fraction
THRESHOLD = (4, 5)
BAND_ROWS, BANDS = 6, 40
#: MinHash values compared at once
STEP = 48
#: posterior probability below which a candidate is dropped
TOLERANCE = 1e-6
#: classes and shingles of a block of a component
BLOCK_DOCS, BLOCK_SHINGLES = 512, 2_000_000


# -- hashing ---------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return _mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20))
                * np.uint64(0x9E3779B97F4A7C15))


_BYTE = _stream(1, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _stream(2, SHINGLE_WORDS) | np.uint64(1)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_MULT = (_stream(3, BANDS * BAND_ROWS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLUS = (_stream(4, BANDS * BAND_ROWS) >> np.uint64(32)).astype(np.uint32)
_BAND_PLACE = _stream(5, BAND_ROWS) | np.uint64(1)
_BAND_SALT = _stream(6, BANDS)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text."""
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(coded), np.uint8)
    inside = np.concatenate([[False], ~_SPACES[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    bounds = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
    cuts = np.searchsorted(starts, bounds)
    if not len(starts):
        return [np.array([], np.uint64) for _ in texts]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _BASE)]))
    letters = _BYTE[data[inside[1:-1]]] * powers[place]
    words = _mix(np.add.reduceat(letters, first) + sizes.astype(np.uint64))
    out = []
    k = SHINGLE_WORDS
    n = max(0, len(words) - k + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams += words[i:i + n] * _PLACE[i]
    grams = _mix(grams)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            short = (words[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.array([], np.uint64))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    best = None
    for a in range(0, len(x), 2048):
        part = (_MULT[:, None] * x[None, a:a + 2048] + _PLUS[:, None]).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.astype(np.uint64).reshape(BANDS, BAND_ROWS)
    return _mix((rows * _BAND_PLACE).sum(axis=1, dtype=np.uint64) ^ _BAND_SALT).view(np.int64)


# -- pairs of a block ------------------------------------------------------------


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For h compared values the least number of matches that keeps a pair:
    with a uniform prior, P(similarity >= t | k of h match) is the chance of at
    most k successes among h + 1 draws of probability t."""
    out = {}
    for h in range(STEP, BANDS * BAND_ROWS + 1, STEP):
        total, k = 0.0, -1
        while total < tolerance:
            k += 1
            total += math.comb(h + 1, k) * threshold ** k * (1 - threshold) ** (h + 1 - k)
        out[h] = k
    return out


_KEEP = least_matches(THRESHOLD[0] / THRESHOLD[1])


def similar(i: int, others: np.ndarray, sign: np.ndarray, flat: np.ndarray, ends: np.ndarray,
            flags: np.ndarray) -> np.ndarray:
    """Those of ``others`` that are linked to ``i``.

    ``flat[ends[j]:ends[j + 1]]`` are the shingles of j as numbers of the
    block, ``flags`` is a zero array over those numbers.
    """
    t, u = THRESHOLD
    size = np.diff(ends)
    n, m = size[i], size[others]
    alive = others[u * np.minimum(n, m) >= t * np.maximum(n, m)]
    matches = np.zeros(len(alive), np.int64)
    for h, least in _KEEP.items():
        if not len(alive):
            return alive
        matches += (sign[alive, h - STEP:h] == sign[i, h - STEP:h]).sum(axis=1)
        ok = matches >= least
        alive, matches = alive[ok], matches[ok]
    if not len(alive):
        return alive
    mine = flat[ends[i]:ends[i + 1]]
    flags[mine] = 1
    sizes = size[alive]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    where = np.arange(int(sizes.sum())) + np.repeat(ends[alive] - first, sizes)
    common = np.add.reduceat(flags[flat[where]], first, dtype=np.int64)
    flags[mine] = 0
    return alive[u * common >= t * (n + sizes - common)]


class Block:
    """Sets of some classes, numbered 0, 1, 2 …"""

    def __init__(self, sets: list[np.ndarray]):
        self.sign = np.stack([min_hashes(s) for s in sets])
        self.ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        known, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flags = np.zeros(len(known), np.uint8)
        self.links = np.zeros(len(sets), np.int64)
        self.up = list(range(len(sets)))

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def compare(self, i: int, others: np.ndarray) -> None:
        found = similar(i, others, self.sign, self.flat, self.ends, self.flags)
        self.links[i] += len(found)
        self.links[found] += 1
        for j in found:
            a, b = self._root(i), self._root(int(j))
            self.up[max(a, b)] = min(a, b)

    def forest(self) -> list[tuple[int, int]]:
        return [(x, r) for x in range(len(self.up)) if (r := self._root(x)) != x]


# -- Spark -----------------------------------------------------------------------


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 bands: bool = True) -> DataFrame:
    """``doc_id, n_shingles, digest`` (null without shingles), band keys and the
    hash of the text."""
    source = df.select(F.col(quoted(id_col)).alias("doc_id"),
                       F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("_text"),
                       F.xxhash64(quoted(text_col)).alias("text_hash"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 4_000_000):
                sets = shingle_sets(texts[a:b])
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                          for s in sets]
                keys = [band_keys(min_hashes(s)) if len(s) else None for s in sets]
                ends = np.concatenate([[0], np.cumsum([BANDS * (k is not None) for k in keys])])
                flat = [k for k in keys if k is not None]
                flat = np.concatenate(flat) if flat else np.array([], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                     batch.column(2).slice(a, b - a)],
                    names=["doc_id", "n_shingles", "digest", "bands", "text_hash"])

    return source.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, "
                                  "bands array<bigint>, text_hash bigint")


def _candidate_components(classes: DataFrame) -> DataFrame:
    """``node, root``: classes that may be linked share a root."""
    rows = classes.select("node", F.explode("bands").alias("key"))
    heads = (rows.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("key", "head"))
    stars = rows.join(heads, "key").where("node <> head").select("node", "head").distinct()
    return stash(components(stars, "node", "head"), "candidates")


def _compare_components(df: DataFrame, classes: DataFrame, member: DataFrame, text_col: str,
                        id_col: str) -> DataFrame:
    """``node, links, other``: links of a class found in one task (to be added
    up), or an edge of a spanning forest (``other`` not null)."""
    member = member.join(classes.select("node", "class_id", "text_hash", "digest", "n_shingles"), "node")
    sizes = member.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS),
                   F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"),
        F.count(F.lit(1)).alias("members"))
    sizes = stash(sizes, "sizes")
    small = sizes.where("blocks = 1").agg(F.sum("members")).first()[0] or 0
    bins = max(1, math.ceil(small / BLOCK_DOCS))
    member = member.join(sizes.select("root", "blocks"), "root")
    # small components share a task; a large one has a task for each pair of its blocks
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    member = member.withColumn("block", mine)
    # a class has one source: the texts of its doc_id are told apart by their hash
    texts = df.select(F.col(quoted(id_col)).alias("class_id"), F.xxhash64(quoted(text_col)).alias("text_hash"),
                      F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    full = member.join(texts, member["class_id"].eqNullSafe(texts["class_id"])
                       & (member["text_hash"] == texts["text_hash"])).select(
        "node", "root", "blocks", "block", "digest", "text").dropDuplicates(["node"])
    dealt = (full.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("node", "root", "block", "digest", "text",
                     F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins)) - bins)
                     .otherwise(F.col("root")).alias("task"),
                     F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y")))

    names = ["node", "links", "other"]

    def run(table: pa.Table) -> pa.Table:
        rows: dict[int, tuple] = {}
        texts = table.column("text").to_pylist()
        meta = zip(*(table.column(c).to_pylist() for c in ("node", "root", "block", "digest")))
        for a, b in slices(texts, 4_000_000):
            for s, (node, root, block, digest) in zip(shingle_sets(texts[a:b]), meta):
                # another text under the same doc_id is not this class
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                    rows[node] = (root, block, node, s)
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        order = sorted(rows.values(), key=lambda r: r[:3])
        out = []
        start = 0
        while start < len(order):
            end = start
            while end < len(order) and order[end][0] == order[start][0]:
                end += 1
            part = order[start:end]
            start = end
            if len(part) < 2:
                continue
            block = Block([r[3] for r in part])
            side = np.array([r[1] for r in part])
            for i in range(len(part)):
                if x == y:
                    block.compare(i, np.arange(i + 1, len(part)))
                elif side[i] == x:
                    block.compare(i, np.flatnonzero(side == y))
            nodes = [r[2] for r in part]
            out += [(nodes[i], int(n), None) for i, n in enumerate(block.links) if n]
            out += [(nodes[i], 0, nodes[j]) for i, j in block.forest()]
        cols = list(zip(*out)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return dealt.groupBy("task", "x", "y").applyInArrow(run, "node long, links long, other long")


def join_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, class_id, n_copies, n_links, group_id`` of every document."""
    return _joined(df, text_col, id_col).drop("text_hash", "root")


def _joined(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The rows of ``join_documents`` with the hash of the text and ``root``, a
    number of the group (null without shingles); several groups may have the
    same smallest doc_id."""
    prints = stash(fingerprints(df, text_col, id_col), "prints")
    source = F.struct("doc_id", "text_hash")
    classes = (prints.where("digest is not null").groupBy("digest")
               .agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), source)), F.min(source)).alias("source"),
                    F.count(F.lit(1)).alias("n_copies"),
                    F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    # numbered as they are written: the numbers are read, never computed again
    classes = stash(classes.select(F.col("source.doc_id").alias("class_id"), "source.text_hash", "digest", "n_copies",
                                   "n_shingles", "bands", F.monotonically_increasing_id().alias("node")), "classes")
    member = _candidate_components(classes)
    found = stash(_compare_components(df, classes, member, text_col, id_col), "links")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    group = components(found.where("other is not null"), "node", "other")
    ids = group.join(classes.select("node", "class_id"), "node")
    smallest = ids.groupBy("root").agg(F.min("class_id").alias("group_id"))
    group = ids.join(smallest, "root").select("node", "root", "group_id")
    info = (classes.select("node", "digest", "class_id", "n_copies").join(links, "node", "left")
            .join(group, "node", "left")
            .select("digest", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("group_id", "class_id").alias("group_id"),
                    F.coalesce("root", "node").alias("root")))
    return prints.select("doc_id", "digest", "text_hash").join(info, "digest", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("group_id", "doc_id").alias("group_id"), "text_hash", "root")


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that represent their group (smallest doc_id, and of
    its texts the one of the smallest hash; a row that repeats doc_id and text is
    kept once)."""
    alone = F.when(F.col("root").isNull(), F.col("text_hash"))
    first = (_joined(df, text_col, id_col).where("doc_id <=> group_id")
             .groupBy("root", alone.alias("alone"), F.col("doc_id").alias("_kept"))
             .agg(F.min("text_hash").alias("_hash")).select("_kept", "_hash"))
    doc, digest = unused(df, "kept", "digest")
    first = first.select(F.col("_kept").alias(doc), F.col("_hash").alias(digest + "_"))
    rows = df.withColumn(digest, F.xxhash64(quoted(text_col)))
    kept = rows.join(first, rows[quoted(id_col)].eqNullSafe(first[doc])
                     & (rows[digest] == first[digest + "_"]), "left_semi")
    return kept.dropDuplicates([id_col, digest]).drop(digest)
