"""Operator 12: substring dedup by suffix automata of reference shards.

A word is removed if it lies in a window of ``window`` consecutive words whose
word sequence starts at another place of the corpus as well.  Suffix automata
decide: the documents' words stream through the automaton of a reference
shard, whose states know how often their strings occur, and spans where the
longest match seen twice reaches the window are removed.

The reference is the corpus itself, so no shard can be sent to every document
(documents times shards).  Reference and stream are cut alike and meet by key:

* every window selects the leftmost smallest hash among its ``GRAM``-word
  grams, its anchor; equal windows select equal anchors.  Consecutive windows
  with one anchor are a run; its words are a piece, about 1.4 windows long;
* only runs whose anchor occurs twice go on.  Pieces of equal words under an
  anchor become one piece with a weight; one occurrence gives its words;
* a shard holds all pieces of its anchors.  Every occurrence of a window lies
  in exactly one piece of exactly one shard, so weighted counts of the
  shard's automaton are counts over the corpus.  The task that builds it
  streams the shard's pieces through it; spans go back to all occurrences by
  an equi-join.  Shards have a bounded number of words;
* pieces of an anchor with more than ``HOT_PIECES`` different ones are halved by
  the place of the anchor in their windows and keyed anew by the words that all
  windows of a half contain.  Keys with one occurrence are dropped, and keys
  that still have too many pieces are halved again, down to single windows.  So
  one anchor never fills a task, a piece makes two rows a round (not one a
  window), and no occurrence is left out.

``matched_spans`` is the same search against a second table of given texts.

Anchors, pieces and windows are compared by 64-bit hashes on their way to a
shard; inside it words are compared as they are.  Words are separated by ASCII
white space.  Defined results: a null or empty text has no word and keeps an
empty text; windows do not reach over the end of a document; rows that share
a doc_id (or have none) are told apart by the hash of their text, and rows
equal in both are copies of each other, all of whose windows repeat; very long
texts are read in blocks; an empty table gives an empty table; extra columns
are kept by ``dedup_documents`` and play no part.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import quoted, stash, unused

#: words of a gram that can be an anchor
GRAM = 8
#: the pieces of a key with more different ones are halved and keyed anew
HOT_PIECES = 256
#: words of a reference shard, on average
SHARD_WORDS = 150_000
#: texts are read in blocks of about this many bytes
BLOCK = 4_000_000
#: distinct words whose hashes a task remembers
REMEMBER = 400_000

DOC = ["doc", "row"]
SPACE = re.compile(rb"[\x20\x09-\x0D]")
ODD = np.uint64(0x9E3779B97F4A7C15)


def _doc(df: DataFrame, text_col: str, id_col: str) -> list[Column]:
    return [F.coalesce(df[f"`{id_col}`"].cast("long"), F.lit(-2**63)).alias("doc"),
            F.xxhash64(df[f"`{text_col}`"]).alias("row")]


def blocks(text: str | None, overlap: int = 0):
    """(number of the first word, words) of blocks of a text; a block starts
    with the last ``overlap`` words of the one before it."""
    raw, at, first, words = (text or "").encode(), 0, 0, []
    while at < len(raw):
        gap = SPACE.search(raw, at + BLOCK)
        end = gap.start() if gap else len(raw)
        carry = words[-overlap:] if overlap else []
        first += len(words) - len(carry)
        words = carry + raw[at:end].split()
        yield first, words
        at = end


class Hashes(dict):
    """64-bit hashes of words, remembered (bounded)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sums(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial in ODD, and the inverse powers that move a
    difference of two of them to the origin (modulo 2^64)."""
    n = len(ids)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, ODD))))
    back = np.full(n, pow(int(ODD), -1, 1 << 64), np.uint64)
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), back)))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * power[:n], dtype=np.uint64))), back


def span_hashes(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words of every span."""
    sums, back = _sums(ids)
    return _mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def gram_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` consecutive words."""
    n = len(ids) - gram + 1
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g += ids[j:j + n] * np.uint64(pow(int(ODD), j + 1, 1 << 64))
    return _mixed(g)


def runs(ids: np.ndarray, part: np.ndarray, window: int):
    """Runs of windows with one anchor: arrays of first word, word behind the
    last one, anchor.  ``part`` numbers the texts the words belong to."""
    gram = min(GRAM, window)
    none = np.zeros(0, np.int64)
    if len(ids) < window:
        return none, none, np.zeros(0, np.uint64)
    g = gram_hashes(ids, gram)
    best, width, want = np.arange(len(g)), 1, window - gram + 1
    while width < want:
        step = min(width, want - width)
        other = best[step:]
        mine = best[:len(other)]
        best = np.where(g[other] < g[mine], other, mine)
        width += step
    whole = np.flatnonzero(part[:len(best)] == part[window - 1:])
    if not len(whole):
        return none, none, np.zeros(0, np.uint64)
    chosen = best[whole]
    cut = np.flatnonzero((np.diff(whole) != 1) | (np.diff(chosen) != 0)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(whole)])) - 1
    return whole[first], whole[last] + window, g[chosen[first]]


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def _occurrences(df: DataFrame, text_col: str, id_col: str, window: int) -> DataFrame:
    """``doc, row, start, n, anchor, piece`` of every run."""
    source = df.select(*_doc(df, text_col, id_col), df[f"`{text_col}`"].cast("string").alias("text"))

    def table(held, hashes):
        """Runs of the gathered (doc, row, first, words)."""
        ids = hashes.of([w for *_, words in held for w in words])
        size = np.array([len(words) for *_, words in held])
        part = np.repeat(np.arange(len(held)), size)
        start, end, anchor = runs(ids, part, window)
        piece = span_hashes(ids, start, end)
        at = part[start] if len(start) else np.zeros(0, np.int64)
        base = np.cumsum(size) - size
        doc, row, first = (np.array([h[i] for h in held], np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(row[at]), pa.array((start - base[at] + first[at]).astype(np.int32)),
             pa.array((end - start).astype(np.int32)), _long(anchor), _long(piece)],
            names=["doc", "row", "start", "n", "anchor", "piece"])

    def find(batches):
        hashes, held, size = Hashes(), [], 0
        for batch in batches:
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                for first, words in blocks(text, window - 1):
                    held.append((doc, row, first, words))
                    size += len(words)
                    if size > BLOCK // 8:
                        yield table(held, hashes)
                        held, size = [], 0
        if held:
            yield table(held, hashes)

    return source.mapInArrow(find, "doc bigint, row bigint, start int, n int, anchor bigint, piece bigint")


class Automaton:
    """Suffix automaton of weighted word sequences."""

    def __init__(self):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]
        self.seen = None

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _step(self, p: int, word) -> int:
        """The state of the string of ``p`` and ``word``, of just that length."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words, weight: int = 1) -> None:
        last = 0
        for w in words:
            if w in self.next[last]:
                last = self._step(last, w)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._step(p, w)
                last = new
            self.count[last] += weight

    def close(self, least: int) -> "Automaton":
        """Sum the counts up; every state then knows its longest suffix that
        occurs ``least`` times or more."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            self.count[self.link[s]] += self.count[s]
        self.seen = [0] * len(self.next)
        for s in order:
            self.seen[s] = self.length[s] if self.count[s] >= least else self.seen[self.link[s]]
        return self

    def matches(self, words) -> list[int]:
        """Matching statistics: for every word the length of the longest string
        ending there that occurs often enough."""
        moves, link, length, seen = self.next, self.link, self.length, self.seen
        state = size = 0
        out = []
        for w in words:
            while state and w not in moves[state]:
                state = link[state]
                size = length[state]
            if w in moves[state]:
                state = moves[state][w]
                size += 1
            out.append(min(size, seen[state]))
        return out

    def spans(self, words, window: int) -> list[list[int]]:
        """Maximal spans covered by matches of at least ``window`` words."""
        out: list[list[int]] = []
        for end, size in enumerate(self.matches(words), 1):
            if size >= window:
                if out and out[-1][1] >= end - size:
                    out[-1] = [min(out[-1][0], end - size), end]
                else:
                    out.append([end - size, end])
        return out


SPANS = "array<struct<a:int,b:int>>"


def _words_of(pieces: DataFrame, df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``key, piece, weight, words`` (joined by a space) of pieces given by
    ``key, piece, weight`` and one occurrence ``at`` (doc, row, start, n)."""
    wanted = (pieces.select("at.doc", "at.row", F.struct("at.start", "at.n", "key", "piece", "weight").alias("p"))
              .groupBy(*DOC).agg(F.collect_list("p").alias("wanted")))
    # rows that are equal in id and text are one source, put together before the shuffle
    texts = (df.select(*_doc(df, text_col, id_col), df[f"`{text_col}`"].cast("string").alias("text"))
             .where("text <> ''").groupBy(*DOC).agg(F.first("text").alias("text")))
    joined = texts.join(wanted, DOC)

    def cut(batches):
        names = ["key", "piece", "weight", "words"]
        for batch in batches:
            rows, size = [], 0
            for text, wanted in zip(batch.column(0), batch.column(1)):
                wanted = sorted(wanted.as_py(), key=lambda p: p["start"])
                longest, at = max(p["n"] for p in wanted), 0
                for first, words in blocks(text.as_py(), longest):
                    while at < len(wanted) and wanted[at]["start"] + wanted[at]["n"] <= first + len(words):
                        p = wanted[at]
                        a = p["start"] - first
                        rows.append((p["key"], p["piece"], p["weight"], b" ".join(words[a:a + p["n"]]).decode()))
                        size += len(rows[-1][3])
                        at += 1
                    if size > BLOCK:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], CUT)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], CUT)

    return joined.select("text", "wanted").mapInArrow(cut, "key bigint, piece bigint, weight bigint, words string")


CUT = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("weight", pa.int64()), ("words", pa.string())])


def _repeated(pieces: DataFrame, shards: int, window: int) -> DataFrame:
    """``key, piece, spans``: what the automaton of its shard finds in a piece."""
    def search(table: pa.Table) -> pa.Table:
        pieces = [(k, p, w, s.encode().split()) for k, p, w, s in zip(
            *(table.column(c).to_pylist() for c in ("key", "piece", "weight", "words")))]
        automaton = Automaton()
        for _, _, weight, words in pieces:
            automaton.add(words, weight)
        automaton.close(2)
        rows = [(k, p, [{"a": a, "b": b} for a, b in automaton.spans(words, window)]) for k, p, _, words in pieces]
        rows = [r for r in rows if r[2]]
        spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows], spans)], names=["key", "piece", "spans"])

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    return pieces.groupBy(shard).applyInArrow(search, f"key bigint, piece bigint, spans {SPANS}")


def _shards(words: int | None) -> int:
    return max(1, -(-(words or 0) // SHARD_WORDS))


PARTS = ("of_key bigint, of_piece bigint, at int, key bigint, piece bigint, weight bigint, words string, "
         "lo int, hi int")


def _halves(batches, window: int):
    """For batches of ``key, piece, weight, words, lo, hi`` (the anchor lies ``lo``
    to before ``hi`` words behind the start of each window) both halves of every
    piece that have a window: its own words, where they start in the piece, and
    the hash of the words that all windows of such a half contain as new key."""
    hashes, gram = Hashes(), min(GRAM, window)
    for batch in batches:
        rows = []
        for key, piece, weight, text, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode().split()
            ids, last = hashes.of(words), len(words) - window
            anchor = int(np.argmin(gram_hashes(ids[:window], gram)))
            half = (lo + hi) // 2
            for lo_, hi_ in ((lo, half), (half, hi)):
                start, stop = max(0, anchor - hi_ + 1), min(last, anchor - lo_) + window
                if stop - start < window:
                    continue
                new, own = span_hashes(ids, np.array([anchor - lo_, start]), np.array([anchor - hi_ + 1 + window, stop]))
                new = _mixed(new + np.uint64(lo_ * window + hi_))
                rows.append((key, piece, start, int(new.view(np.int64)), int(own.view(np.int64)), weight,
                             b" ".join(words[start:stop]).decode(), lo_, hi_))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PART.types)], schema=PART)


PART = pa.schema([("of_key", pa.int64()), ("of_piece", pa.int64()), ("at", pa.int32()), ("key", pa.int64()),
                  ("piece", pa.int64()), ("weight", pa.int64()), ("words", pa.string()), ("lo", pa.int32()),
                  ("hi", pa.int32())])


def _hot_spans(pieces: DataFrame, window: int) -> DataFrame:
    """``key, piece, spans`` of pieces (``key, piece, weight, words, lo, hi``) of
    hot keys: they are halved and keyed anew."""
    parts = stash(pieces.select("key", "piece", "weight", "words", "lo", "hi")
                  .mapInArrow(lambda batches: _halves(batches, window), PARTS), "sub-parts")
    halves = stash(parts.groupBy("key", "piece").agg(
        F.sum("weight").alias("weight"), *[F.first(c).alias(c) for c in ("words", "lo", "hi")]), "sub-halves")
    # windows under a key with one occurrence are seen once
    keys = halves.groupBy("key").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("c")).where("all > 1")
    keys = stash(keys.select("key", (F.col("c") > HOT_PIECES).alias("hot")), "sub-keys")
    # the halves of a single window are equal
    keyed = halves.join(keys, "key").withColumn("hot", F.col("hot") & (F.col("hi") - F.col("lo") > 1))
    plain, hot = keyed.where("not hot"), keyed.where("hot")
    size, n_hot = keyed.agg(F.sum(F.when(F.col("hot"), 0).otherwise(window + F.col("hi") - F.col("lo"))),
                            F.count_if("hot")).first()
    spans = _repeated(plain.select("key", "piece", "weight", "words"), _shards(size), window)
    if n_hot:
        spans = spans.union(_hot_spans(hot, window))
    return _moved(parts.select("of_key", "of_piece", F.col("at").alias("start"), "key", "piece"),
                  stash(spans, "sub-spans"), ["of_key", "of_piece"]).withColumnsRenamed({"of_key": "key", "of_piece": "piece"})


def _moved(some: DataFrame, spans: DataFrame, owner: list[str]) -> DataFrame:
    """The spans of the pieces that start at word ``start`` of an owner, gathered by owner."""
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"),
                                                    (s["b"] + F.col("start")).alias("b")))
    return (some.join(spans, ["key", "piece"]).select(*owner, moved.alias("spans"))
            .groupBy(*owner).agg(F.flatten(F.collect_list("spans")).alias("spans")))


def repeated_spans(df: DataFrame, window: int = 35, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc, row, spans``: the spans (from word ``a`` to before word ``b``) of
    every document that has any; they may overlap."""
    every = stash(_occurrences(df, text_col, id_col, window), "sub-runs")
    # written, so that Spark can split the join's tasks at a very common anchor
    twice = stash(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "sub-twice")
    some = stash(every.join(twice, "anchor").withColumnRenamed("anchor", "key"), "sub-some")
    pieces = stash(some.groupBy("key", "piece").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct(*DOC, "start", "n")).alias("at")), "sub-pieces")
    hot = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_PIECES).select("key")
    hot = stash(hot, "sub-hot-keys")
    plain = pieces.join(hot, "key", "left_anti")
    cut = stash(_words_of(plain, df, text_col, id_col), "sub-words")
    words = plain.agg(F.sum("at.n")).first()[0]
    spans = _repeated(cut, _shards(words), window)
    if not hot.isEmpty():
        many = stash(_words_of(pieces.join(hot, "key", "left_semi"), df, text_col, id_col), "sub-hot")
        # an anchor may start at any word of a window that leaves room for it
        many = many.withColumns({"lo": F.lit(0), "hi": F.lit(window - min(GRAM, window) + 1)})
        spans = spans.union(_hot_spans(many, window))
    return stash(_moved(some, stash(spans, "sub-spans"), DOC), "sub-found")


def dedup_documents(df: DataFrame, window: int = 35, text_col: str = "text", id_col: str = "doc_id",
                    keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with the text replaced by its kept
    words joined by a space, and ``n_words``, ``n_removed`` of every document."""
    return _without(df, repeated_spans(df, window, text_col, id_col), text_col, id_col, keep)


def _without(df: DataFrame, found: DataFrame, text_col: str, id_col: str, keep: list[str] | None) -> DataFrame:
    keep = list(df.columns) if keep is None else keep
    row, doc, digest, spans, text = unused(df, "row", "doc", "digest", "spans", "words")
    others = [c for c in keep if c != text_col]
    held = df.select(F.struct(F.lit(0).alias(unused(df, "_")[0]), *[F.col(quoted(c)) for c in others]).alias(row),
                     *[c.alias(n) for c, n in zip(_doc(df, text_col, id_col), (doc, digest))],
                     df[f"`{text_col}`"].cast("string").alias(text))
    found = found.select(F.col("doc").alias(doc), F.col("row").alias(digest), F.col("spans").alias(spans))
    joined = held.join(found, [doc, digest], "left").select(row, text, spans)

    def cut(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for t, found in zip(batch.column(1), batch.column(2)):
                merged: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in found.as_py() or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                n, parts, gone = 0, [], sum(b - a for a, b in merged)
                for first, words in blocks(t.as_py()):
                    n = first + len(words)
                    at = first
                    for a, b in merged:
                        if b > at and a < n:
                            parts.extend(words[at - first:max(a, at) - first])
                            at = min(b, n)
                    parts.extend(words[at - first:])
                kept.append(b" ".join(parts).decode())
                n_words.append(n)
                n_removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64())], names=["r", "t", "n_words", "n_removed"])

    schema = T.StructType([T.StructField("r", joined.schema[row].dataType), T.StructField("t", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = joined.mapInArrow(cut, schema)
    names = [c for c in keep if c not in ("n_words", "n_removed")]
    return out.select(*[F.col("t").alias(c) if c == text_col else F.col(f"r.{quoted(c)}") for c in names],
                      "n_words", "n_removed")


def matched_spans(df: DataFrame, reference: list[str], window: int = 35, text_col: str = "text",
                  id_col: str = "doc_id", max_words: int = 4 * SHARD_WORDS) -> DataFrame:
    """``doc, row, spans`` of the documents that share a window with a list of
    reference texts: its automata, by shards of ``SHARD_WORDS``, are broadcast.

    For lists of a known size: more than ``max_words`` words are refused
    (append such a table to the documents and use ``repeated_spans``)."""
    shards: list[list[list[bytes]]] = [[]]
    size = total = 0
    for text in reference:
        words = (text or "").encode().split()
        total += len(words)
        if total > max_words:
            raise ValueError(f"more than {max_words} words of reference texts")
        # a long text is cut into overlapping parts that hold each of its windows once
        for a in range(0, max(1, len(words) - window + 1), SHARD_WORDS):
            part = words[a:a + SHARD_WORDS + window - 1]
            if size + len(part) > 2 * SHARD_WORDS:
                shards.append([])
                size = 0
            shards[-1].append(part)
            size += len(part)
    shared = df.sparkSession.sparkContext.broadcast(shards)
    source = df.select(*_doc(df, text_col, id_col), df[f"`{text_col}`"].cast("string").alias("text"))

    def stream(batches):
        automata = []
        for texts in shared.value:
            automata.append(Automaton())
            for words in texts:
                automata[-1].add(words)
            automata[-1].close(1)
        for batch in batches:
            rows = defaultdict(list)
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                for first, words in blocks(text, window - 1):
                    for automaton in automata:
                        rows[doc, row] += [{"a": a + first, "b": b + first} for a, b in automaton.spans(words, window)]
            kept = [(*k, v) for k, v in rows.items() if v]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in kept], pa.int64()),
                                              pa.array([r[1] for r in kept], pa.int64()),
                                              pa.array([r[2] for r in kept], kind)], names=["doc", "row", "spans"])

    return source.mapInArrow(stream, f"doc bigint, row bigint, spans {SPANS}")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
wins AS (SELECT r, p, string_agg(word, ' ') OVER x AS k, count(*) OVER x AS n FROM words
         WINDOW x AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
full_wins AS (SELECT r, p, md5(k) AS k FROM wins WHERE n = 35),
twice AS (SELECT r, p FROM full_wins SEMI JOIN (SELECT k FROM full_wins GROUP BY k HAVING count(*) > 1) USING (k)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM twice),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
         FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""
