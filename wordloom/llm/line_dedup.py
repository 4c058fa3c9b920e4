"""Operator 3: line dedup as an exact set-similarity join.

A line is the set of its words; a line is removed if an earlier line (smaller
doc_id, then smaller hash of the whole text, then smaller line number; removed
lines count as well) has a Jaccard similarity of at least 0.8.  Lines of the same set are settled by an
aggregate; between different sets the join works on prefixes:

* words are ordered by rarity: classes of the logarithm of their count over
  the whole corpus (counted in 2^18 hash cells), then by hash;
* two sets that are similar share a word among the first
  ``n - ceil(0.8 n) + 1`` of each (prefix filter), their sizes differ by a
  fifth at most (length filter), the places of the first shared word leave
  enough words behind it (positional filter), and outlines of the sets (64 bits, 128 of
  long ones) differ in few bits;
* a semi join keeps the prefix rows that have any partner left; only their
  lines are read again, and pairs are verified on the words.

A group of many near copies is not paired off: each line is first verified
against the earliest line of its buckets, twice, and only lines that match
neither are compared with all earlier partners.

Built-in functions only; the classes, a long a cell, are a scalar value of the
plan.  ``Words``, ``_pieces`` and ``_sets`` are the numpy form of the sets used
before; no query reads them, a test still holds them.  Defined results: words are separated by ASCII white
space, a line without a word is kept and matches nothing; a null or empty text
has no line to remove; a null doc_id comes first; rows that share a doc_id are
told apart by the 64-bit hash of their text, so only rows equal in both share
their decisions; an empty table gives an empty table; extra columns are not
touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import gathering, quoted, remove, stash, unused
from .url_filter import MAX_BITS, Level

CELL_BITS = 18
CELLS = 1 << CELL_BITS
#: bytes of text that are hashed in one pass (a longer line makes a longer pass)
BLOCK = 1 << 18
#: a document is its id and the hash of its text
DOC = ["doc", "row"]
PLACE = [*DOC, "line"]
ROW = [*PLACE, "n", "p"]
#: the places of a pair
X, Y = ["xd", "xr", "xl"], ["yd", "yr", "yl"]
#: words of 64 bits in the outline of a line
WIDE = 2
WIDE_ROW = [f"w{i}" for i in range(WIDE)]
#: words of a set from which its outline takes 128 bits, else 64
LONG = 96

SPACE = bytes(c == 0x20 or 0x09 <= c <= 0x0D for c in range(256))
ODD = 0x9E3779B97F4A7C15
#: a number of 64 bits for every byte
BYTES = np.random.default_rng(3).integers(1, 1 << 64, 256, np.uint64)
SETS = ("doc bigint, row bigint, line int, n int, f1 bigint, f2 bigint, prefix array<bigint>, "
        + ", ".join(f"{w} bigint" for w in WIDE_ROW))


def _doc(df: DataFrame, text_col: str, id_col: str) -> list[Column]:
    return [F.coalesce(df[f"`{id_col}`"].cast("long"), F.lit(-2**63)), F.xxhash64(df[f"`{text_col}`"])]


def _lines(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    # hashed below the explode, once a text
    texts = df.select(*[c.alias(n) for c, n in zip(_doc(df, text_col, id_col), DOC)],
                      _spaced(df[f"`{text_col}`"].cast("string")).alias("text"))
    return texts.select(*DOC, F.posexplode(F.split("text", "\n")).alias("line", "s"))


def _spaced(text: Column) -> Column:
    """The text with plain spaces for all others but line breaks."""
    plain, odd = text, F.lit(False)
    for c in "\t\x0b\x0c\r":
        plain, odd = F.replace(plain, F.lit(c), F.lit(" ")), odd | F.contains(text, F.lit(c))
    return F.when(odd, plain).otherwise(text)


def _split(line: Column) -> Column:
    """The words of a spaced line, and an empty string for every further space."""
    return F.split(line, " ")


def _words(line: Column) -> Column:
    """The words of a spaced line."""
    gaps = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(gaps, F.array_remove(_split(line), "")).otherwise(_split(line))


def _cell(h: Column) -> Column:
    """The hash cell of a word."""
    return F.shiftrightunsigned(h, 64 - CELL_BITS)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _pieces(batches):
    """Lists of (doc, row, first line, bytes) of about BLOCK bytes; a longer
    text is cut between lines."""
    held, size = [], 0
    for batch in batches:
        for doc, row, text in zip(*batch.columns):
            if not text.is_valid:
                continue
            doc, row, text = doc.as_py(), row.as_py(), text.as_buffer().to_pybytes()
            line, at = 0, 0
            while len(text) - at > BLOCK:
                cut = text.rfind(b"\n", at, at + BLOCK)
                cut = cut if cut >= 0 else text.find(b"\n", at)
                if cut < 0:
                    break
                yield [(doc, row, line, text[at:cut])]
                line, at = line + text.count(b"\n", at, cut) + 1, cut + 1
            held.append((doc, row, line, text[at:]))
            size += len(text) - at + 64
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


class Words:
    """Hashes of the words of a list of texts, and where they stand."""

    def __init__(self):
        self.power, self.back = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, BLOCK * 2)
            for name, by in (("power", ODD), ("back", pow(ODD, -1, 1 << 64))):
                factors = np.full(n, by, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))

    def of(self, texts: list[bytes]):
        """The words' hashes, how many every line has, and the first line of every text."""
        # a line break behind every text ends its last word
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        self._powers(len(raw))
        space = np.frombuffer(joined.translate(SPACE), bool)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[::2], edge[1::2]
        # differences of prefix sums of a polynomial, moved to the origin
        sums = BYTES.take(raw, mode="clip")
        sums *= self.power[:len(raw)]
        np.cumsum(sums, out=sums)
        before = np.where(start > 0, sums[start - 1], np.uint64(0))
        hashes = (sums[end - 1] - before) * self.back[start]
        hashes = _mixed(hashes ^ (end - start).astype(np.uint64), 0xBF58476D1CE4E5B9)
        breaks = np.flatnonzero(raw == 10)
        first = np.cumsum([0, *map(len, texts[:-1])]) + np.arange(len(texts))
        counts = np.diff(np.searchsorted(start, breaks), prepend=0)
        return hashes, counts, np.searchsorted(breaks, first)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def rarity_classes(df: DataFrame, text_col: str) -> DataFrame:
    """One row: for every hash cell the bits that turn the upper seven of its
    hashes into the rounded logarithm of its words' count."""
    text = F.replace(_spaced(df[f"`{text_col}`"].cast("string")), F.lit("\n"), F.lit(" "))
    words = df.select(F.explode(_split(text)).alias("w"))
    counts = words.groupBy(_cell(F.xxhash64("w")).alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    dense = (df.sparkSession.range(CELLS).withColumnRenamed("id", "cell").join(counts, "cell", "left")
             .select("cell", F.floor(F.log2(F.coalesce("c", F.lit(1)))).cast("long").alias("k")))
    k = F.shiftleft(F.col("k").bitwiseXOR(F.shiftright("cell", CELL_BITS - 7)), 57)
    return dense.agg(F.sort_array(F.collect_list(F.struct("cell", k.alias("k")))).alias("a")).select(
        F.col("a.k").alias("classes"))


def _sets(words: Words, classes: np.ndarray, pieces: list) -> pa.RecordBatch | None:
    h, counts, first_line = words.of([p[3] for p in pieces])
    if not len(h):
        return None
    filled = np.flatnonzero(counts)
    text = np.searchsorted(first_line, filled, "right") - 1
    line = filled - first_line[text]
    of = np.repeat(np.arange(len(filled)), counts[filled])
    # rarest first: one number for the line, the class and the upper bits of the hash
    bits = np.uint64(max(1, int(len(text) - 1).bit_length()))
    k = classes[_cells(h)].astype(np.uint64)
    number = (of.astype(np.uint64) << (np.uint64(64) - bits)) | (((k << np.uint64(58)) | (h >> np.uint64(6))) >> bits)
    order = np.argsort(number)
    number, sorted_h = number[order], h[order]
    same = number[1:] == number[:-1]
    if (same & (sorted_h[1:] != sorted_h[:-1])).any():
        order = np.lexsort((h, number[np.argsort(order)]))
        sorted_h = h[order]
        same &= sorted_h[1:] == sorted_h[:-1]
    once = np.concatenate(([True], ~same))
    h, of, k = sorted_h[once], of[order][once], k[order][once]
    at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    n = np.diff(np.concatenate((at, [len(of)])))
    digests = [np.add.reduceat(_mixed(h, by), at) for by in (0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
    bit, part = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(WIDE - 1)
    outline = [np.bitwise_xor.reduceat(np.where(part == i, bit, np.uint64(0)), at) for i in range(WIDE)]
    # below 4 words no other set can be similar
    size = np.where(n < 4, 0, n - (4 * n + 4) // 5 + 1)
    place = np.arange(len(of)) - at[of]
    keys = ((k << np.uint64(57)) | (h >> np.uint64(7)))[place < size[of]]
    doc, row, first = (np.array([p[i] for p in pieces], np.int64) for i in range(3))
    prefix = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(keys.view(np.int64)))
    longs = [pa.array(x.view(np.int64)) for x in (*digests, *outline)]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[text]), pa.array(row[text]), pa.array((first[text] + line).astype(np.int32)),
         pa.array(n.astype(np.int32)), *longs[:2], prefix, *longs[2:]],
        names=[*PLACE, "n", "f1", "f2", "prefix", *WIDE_ROW])


def _outline(keys: str) -> list[Column]:
    """64 bits, each the parity of the words that fall on it, so that the bits
    that differ are at most the words that differ, and those of half the words;
    only long sets need both."""
    def fold(bit):
        return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(
            F.call_function("shiftleft", bit(k), k.bitwiseAND(F.lit(63)).cast("int"))))

    every, upper = F.lit(1).cast("long"), lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1))
    half = F.when(F.col("n") < LONG, F.lit(0).cast("long")).otherwise(fold(upper))
    return [fold(lambda k: every).alias("every"), half.alias("w1")]


def line_sets(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """Every line with a word: its place, ``n`` distinct words, the digest of
    their set, its prefix (rarest words first) and its outline."""
    # the table is named as a column for the lambda; the optimizer folds it into its only use
    lines = (lines.where(F.trim("s") != "")
             .withColumn("_classes", classes.select("classes").scalar()))
    # lambdas are interpreted, node by node, so they do as little as they can
    hashes = F.transform(_words(F.col("s")), lambda w: F.xxhash64(w))
    keys = F.transform(hashes, lambda h: h.bitwiseXOR(F.col("_classes")[_cell(h)]))
    keyed = lines.select(*PLACE, F.sort_array(F.array_distinct(keys)).alias("keys"))
    sized = keyed.select(*PLACE, F.size("keys").alias("n"), "keys")
    sets = sized.select(*PLACE, "n", F.xxhash64("keys").alias("f1"),
                        F.xxhash64(F.lit(7), "keys").alias("f2"), "keys", *_outline("keys"))
    # below 4 words no other set can be similar
    size = F.when(F.col("n") < 4, 0).otherwise(F.expr("cast(n - (4 * n + 4) div 5 + 1 as int)"))
    return sets.select(*PLACE, "n", "f1", "f2", F.slice("keys", F.lit(1), size).alias("prefix"),
                       F.col("every").bitwiseXOR(F.col("w1")).alias("w0"), "w1")


def _earlier(x: str, y: str) -> Column:
    """y lies before x."""
    a, b = ([F.col(f"{side}.{c}") for c in PLACE] for side in (x, y))
    return (b[0] < a[0]) | ((b[0] == a[0]) & ((b[1] < a[1]) | ((b[1] == a[1]) & (b[2] < a[2]))))


def _possible() -> Column:
    """Outline, length and positional filters of two prefix rows with one key; the
    last holds at the first key that two similar sets share, so no pair is lost."""
    nx, ny, px, py = (F.col(c) for c in ("x.n", "y.n", "x.p", "y.p"))
    w0, w1 = (F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}")) for w in WIDE_ROW)
    # the bits of all words first; two long sets have more to tell them apart
    return ((9 * F.bit_count(w0.bitwiseXOR(w1)) <= nx + ny)
            & (5 * nx >= 4 * ny) & (5 * ny >= 4 * nx)
            & (9 * (F.least(nx - px, ny - py) + 1) >= 4 * (nx + ny))
            & ((nx < LONG) | (ny < LONG) | (9 * (F.bit_count(w0) + F.bit_count(w1)) <= nx + ny)))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Places x whose pair (x, y) has similarity 0.8 or more on the words."""
    x, y = (texts.select(*[F.col(c).alias(k) for c, k in zip([*PLACE, "s"], [*at, side + "s"])])
            for side, at in (("x", X), ("y", Y)))
    full = pairs.join(x, X).join(y, Y)
    common = F.array_remove(F.array_intersect(_split(F.col("xs")), _split(F.col("ys"))), "")
    return full.where(9 * F.size(common) >= 4 * F.col("n")).select(
        *[F.col(k).alias(c) for c, k in zip(PLACE, X)]).distinct()


def _pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """Places of possible pairs, y before x, a pair for every shared key."""
    joined = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key"))
                               & _earlier("x", "y") & _possible())
    return joined.select(*[F.col(f"x.{c}").alias(k) for c, k in zip(PLACE, X)],
                         *[F.col(f"y.{c}").alias(k) for c, k in zip(PLACE, Y)],
                         (F.col("x.n") + F.col("y.n")).alias("n"))


def _filter(keys: DataFrame, n_keys: int) -> Level | None:
    """A Bloom filter of the keys, if one within ``MAX_BITS`` is of use."""
    if not n_keys:
        return None
    rate = max(0.01, 2 ** (-MAX_BITS * math.log(2) / n_keys))
    return Level(keys, n_keys, rate, 1) if rate <= 0.5 else None


def _similar_to_earlier(sets: DataFrame, lines: DataFrame) -> DataFrame:
    """Places of first lines of a set that have an earlier similar line."""
    rows = sets.select("id", "n", *WIDE_ROW, F.posexplode("prefix").alias("p", "key"))
    rows = rows.select("key", "id", "n", (F.col("p") + 1).alias("p"), *WIDE_ROW)
    met = rows.alias("x").join(
        rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & _possible(),
        "left_semi")
    rows = stash(met.join(sets.select("id", *PLACE), "id").select("key", *ROW, *WIDE_ROW), "line-rows")
    other = ((F.col("x.doc") != F.col("y.doc")) | (F.col("x.row") != F.col("y.row"))
             | (F.col("x.line") != F.col("y.line")))
    places = stash(rows.select(*PLACE).distinct(), "line-places")
    n_places = places.count()
    if not n_places:
        return places
    # the texts of those lines; Bloom filters, where they fit, spare the other
    # documents their split and the other lines their shuffle
    for key in F.xxhash64(*DOC), F.xxhash64(*PLACE):
        if (wanted := _filter(places.select(key.alias("key")), n_places)) is not None:
            lines = lines.where(wanted.has(key))
    texts = stash(lines.join(places, PLACE).select(*PLACE, "s"), "line-texts")

    def lead_of(some):
        return some.groupBy("key").agg(F.min(F.struct(*ROW, *WIDE_ROW)).alias("r")).select("key", "r.*")

    def hits(some, lead):
        first = (_pairs(some, lead).groupBy(*X).agg(F.min(F.struct(*Y, "n")).alias("y"))
                 .select(*X, "y.*"))
        return stash(_verify(first, texts), "line-hits")

    # nothing lies before the first line of a bucket: it asks for no partner there
    lead = lead_of(rows)
    one = hits(rows, lead)
    left = stash(rows.join(one, PLACE, "left_anti").alias("x").join(
        lead.alias("y"), (F.col("x.key") == F.col("y.key")) & ~other, "left_anti"), "line-rest")
    # the first line of what is left is a partner for the others, and still asks itself
    two = hits(left, lead_of(left))
    left = stash(left.join(two, PLACE, "left_anti"), "line-rest")
    last = stash(_verify(_pairs(left, rows).distinct(), texts), "line-hits")
    return one.union(two).union(last).distinct()


def removed_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc`` (the document's id; a null as the smallest long), ``row`` (the
    hash of its text) and ``lines``, the sorted numbers (from 0) of its removed lines, where there are any."""
    lines = _lines(df, text_col, id_col)
    place = F.struct(*PLACE)
    with gathering([]) as used:
        classes = stash(rarity_classes(df, text_col), "line-classes")
        every = stash(line_sets(lines, classes), "line-sets")
        # digests that lines may share; all other lines need no shuffle to be told apart
        shared = stash(every.groupBy("f1").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
                       .select(F.col("f1").alias("key")), "line-shared")
        n_shared = shared.count()
        again = _filter(shared, n_shared)
    maybe = F.lit(n_shared > 0) if again is None else again.has(F.col("f1"))
    alone, rest = every.where(~maybe), every.where(maybe)
    others = ["n", "prefix", *WIDE_ROW]
    firsts = rest.groupBy("f1", "f2").agg(F.min(place).alias("first"))
    copies = stash(rest.select("f1", "f2", *PLACE).join(firsts, ["f1", "f2"]).where(place != F.col("first"))
                   .select(*PLACE), "line-copies")
    sets = (rest.where("n >= 4").groupBy("f1", "f2").agg(F.min(place).alias("first"), *[F.first(c).alias(c) for c in others])
            .select("first.*", *others))
    sets = sets.union(alone.where("n >= 4").select(*PLACE, *others))
    # the number is written with its row, so it is the same for all readers
    sets = stash(sets.withColumn("id", F.monotonically_increasing_id()), "line-firsts")
    for path in used:
        remove(df.sparkSession, path)
    similar = _similar_to_earlier(sets, lines)
    return (copies.union(similar.select(*PLACE)).groupBy(*DOC)
            .agg(F.sort_array(F.collect_set("line")).alias("lines")))


def judged_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` of every document."""
    removed = removed_lines(df, text_col, id_col)
    n_lines = F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(n_lines, F.lit(0)).alias("n_lines"),
                     *[c.alias(n) for c, n in zip(_doc(df, text_col, id_col), DOC)])
    none = F.array().cast("array<int>")
    return docs.join(removed, DOC, "left").select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        F.size(F.coalesce("lines", none)).cast("long").alias("n_removed"),
        F.coalesce("lines", none).alias("removed"))


def dedup_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` without the removed lines; a document that had words and lost
    every line with a word goes."""
    removed = removed_lines(df, text_col, id_col)
    others = [c for c in df.columns if c != text_col]
    # the columns travel as one, whatever their names are
    held = df.select(F.struct(F.lit(0).alias(unused(df, "_")[0]), *[F.col(quoted(c)) for c in others]).alias("held"),
                     F.col(quoted(text_col)).alias("text"),
                     *[c.alias(n) for c, n in zip(_doc(df, text_col, id_col), DOC)])
    joined = held.join(removed, DOC, "left").withColumn("all", F.split("text", "\n"))
    numbers = F.sequence(F.lit(0), F.size("all") - 1)
    kept = F.transform(F.array_except(numbers, F.col("lines")), lambda i: F.get(F.col("all"), i))
    out = joined.withColumn("kept", F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    out = out.where(F.col("lines").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"held.{quoted(c)}") for c in df.columns])
