"""Operator 7: packing token sequences by non-negative least squares.

A document is its token ids and an end id.  Windows of 2048 ids are cut off
its start; what remains (1 to 2047 ids) is packed.  Remainders are dealt by
hash into groups of a bounded number of documents; the number of a copy among
the equal rows of its input partition, which does not depend on their order,
spreads repeated rows over the groups.  In a group, combinations
of two or three lengths that fill a window exactly are enumerated, the number
of times each should be used is the non-negative least-squares fit to the
histogram of lengths, the fit is rounded within what is there, and what is
left over is packed greedily: windows are filled in order, the piece at a
border is cut.  The ids left in a group's last window are cut into pieces of
powers of two, which need no padding.

Tokenising runs where the rows lie, by the rank file of the same vocabulary
(ids equal to those of the JSON tokenizer, several times faster; a test
compares the two); the JSON's special string in a text becomes its id, as
that library does by default.  A run of white space too long for the rank
file's regex (it gives up near a million) is cut out by the same rule and
encoded as the one piece that it is.

Defined results: a null or empty text is the end id alone; documents that
share an id are packed as separate documents; an empty table gives no pieces;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: id behind every document
END_ID = 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: runs of white space (as the pattern's ``\s``) from this length on skip the regex
LONG_RUN = 100_000
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: documents of a group on average
GROUP_DOCS = 8192


class Tokenizer:
    """Byte-level BPE from a rank file."""

    def __init__(self, rank_path: str, pattern: str):
        self.rank_path, self.pattern, self.encoding, self.one_piece = rank_path, pattern, None, None

    def _load(self, pattern: str):
        import tiktoken

        with open(self.rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without the special string."""
        out: list[int] = []
        done = 0
        for m in WHITE.finditer(text) if len(text) >= LONG_RUN else ():
            # a run is one piece, but for its last character where a word follows
            end = m.end() - (m.end() < len(text))
            if end - m.start() >= LONG_RUN:
                out += self.encoding.encode_ordinary(text[done:m.start()])
                # loaded only where such a run occurs: it takes memory of its own
                self.one_piece = self.one_piece or self._load(r"[\s\S]+")
                out += self.one_piece.encode_ordinary(text[m.start():end])
                done = end
        return out + self.encoding.encode_ordinary(text[done:])

    def ids(self, text: str) -> list[int]:
        if self.encoding is None:
            self.encoding = self._load(self.pattern)
        if SPECIAL not in text:
            return self._plain(text)
        out: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL_ID] * (k > 0) + self._plain(part)
        return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# -- one group -------------------------------------------------------------------


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples of lengths that fill the window, rows padded with 0.

    Triples are built from lengths that outnumber their partner in a pair.
    """
    present = np.flatnonzero(hist)
    a = present[present <= window // 2]
    a = a[hist[window - a] > 0]
    pairs = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    extra = present[hist[present] > hist[window - present]]
    rows = []
    for x in extra[extra <= window // 3]:
        y = extra[(extra >= x) & (extra <= (window - x) // 2)]
        z = window - x - y
        ok = hist[z] > hist[window - z]
        rows.append(np.stack([np.full(ok.sum(), x), y[ok], z[ok]], axis=1))
    return np.concatenate([pairs, *rows]).astype(np.int64)


def fit_counts(combos: np.ndarray, hist: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Non-negative x that minimises |A x - hist|, A counting the lengths of each
    combination (multiplicative steps keep x non-negative)."""
    target = hist.astype(np.float64)
    target[0] = 0.0
    x = np.ones(len(combos))
    wanted = target[combos].sum(axis=1)
    for _ in range(rounds):
        made = np.bincount(combos.ravel(), np.repeat(x, 3), minlength=len(hist))
        made[0] = 0.0
        x *= wanted / np.maximum(made[combos].sum(axis=1), 1e-12)
    return x


def plan_windows(lengths: np.ndarray, window: int = WINDOW) -> tuple[list[list[int]], list[int]]:
    """Windows that whole pieces fill exactly, and the pieces left over
    (numbers of pieces; lengths below the window)."""
    hist = np.bincount(lengths, minlength=window + 1)
    combos = combinations(hist, window)
    x = fit_counts(combos, hist) if len(combos) else np.zeros(0)
    stock = [[] for _ in range(window + 1)]
    for i in np.argsort(lengths, kind="stable")[::-1]:
        stock[lengths[i]].append(int(i))
    windows = []
    for c in np.argsort(-x, kind="stable"):
        parts = [int(v) for v in combos[c] if v]
        for _ in range(max(1, round(float(x[c])))):
            if any(len(stock[v]) < parts.count(v) for v in parts):
                break
            windows.append([stock[v].pop() for v in parts])
    left = [i for v in range(window, 0, -1) for i in stock[v]]
    return windows, left


def pack_group(lengths: np.ndarray, window: int = WINDOW):
    """Places of all pieces: ``(piece, from, to, sequence, offset)``."""
    windows, left = plan_windows(lengths, window)
    out = []
    for s, members in enumerate(windows):
        at = 0
        for i in members:
            out.append((i, 0, int(lengths[i]), s, at))
            at += int(lengths[i])
    total = int(sum(lengths[i] for i in left))
    # sizes of the sequences that the leftovers fill: whole windows, then powers of two
    sizes = [window] * (total // window)
    sizes += [1 << b for b in range(window.bit_length() - 1, -1, -1) if total % window >> b & 1]
    s, room, at = len(windows) - 1, 0, 0
    sizes_left = iter(sizes)
    for i in left:
        done = 0
        while done < lengths[i]:
            if not room:
                room, s, at = next(sizes_left), s + 1, 0
            take = min(room, int(lengths[i]) - done)
            out.append((i, done, done + take, s, at))
            done, room, at = done + take, room - take, at + take
    return out


# -- Spark -----------------------------------------------------------------------


def tokenised_parts(df: DataFrame, tokenizer: Tokenizer, text_col: str = "text",
                    id_col: str = "doc_id", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Whole windows and the remainder of every document:
    ``doc_id, doc_tokens, start, length, ids`` (little-endian uint16; null for a
    whole window without ``with_ids``, which needs no partner), ``copy``, the
    row's number among the equal rows of its input partition, and ``crc``."""
    source = df.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            docs, texts = batch.columns
            for a in range(0, batch.num_rows, 512):
                rows, total, start, length, ids, copy, sums = [], [], [], [], [], [], []
                for k, (doc, text) in enumerate(zip(docs.slice(a, 512).to_pylist(),
                                                    texts.slice(a, 512).to_pylist()), a):
                    key = hash((str(doc), text))
                    seen[key] = seen.get(key, -1) + 1
                    coded = np.array(tokenizer.ids(text) + [END_ID], np.uint16)
                    for b in range(0, len(coded), window):
                        part = coded[b:b + window]
                        rows.append(k)
                        total.append(len(coded))
                        start.append(b)
                        length.append(len(part))
                        ids.append(part.tobytes() if with_ids or len(part) < window else None)
                        sums.append(crc(part))
                        copy.append(seen[key])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(total, pa.int64()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(copy, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "doc_tokens", "start", "length", "ids", "copy", "crc"])

    return source.mapInArrow(run, f"doc_id {kind}, doc_tokens bigint, start bigint, "
                                  "length bigint, ids binary, copy bigint, crc bigint")


def pack_documents(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text",
                   id_col: str = "doc_id", window: int = WINDOW, group_docs: int = GROUP_DOCS,
                   with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` (and ``ids``, little-endian uint16)."""
    groups = max(1, math.ceil(df.count() / group_docs))
    parts = tokenised_parts(df, Tokenizer(rank_path, pattern), text_col, id_col, window, with_ids)
    kind = parts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names += ["ids"] * with_ids

    dealt = parts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crc", "start", "copy"),
                                           F.lit(groups))).drop("copy")

    def pack(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        length = table.column("length").to_numpy()
        start, crcs = table.column("start").to_numpy(), table.column("crc").to_numpy()
        raw = table.column("ids").to_pylist()
        whole = np.flatnonzero(length == window)
        rest = np.flatnonzero(length < window)
        places = [(int(i), 0, window, s, 0) for s, i in enumerate(whole)]
        places += [(int(rest[i]), a, b, s + len(whole), at)
                   for i, a, b, s, at in pack_group(length[rest], window)] if len(rest) else []
        sums, cut = [], []
        for i, a, b, _, _ in places:
            if b - a == length[i]:
                sums.append(int(crcs[i]))
                cut.append(raw[i])
            else:
                cut.append(raw[i][2 * a:2 * b])
                sums.append(crc(np.frombuffer(cut[-1], np.uint16)))
        rows = np.array([p[0] for p in places])
        a, b, s, at = (np.array([p[j] for p in places], np.int64) for j in (1, 2, 3, 4))
        cols = [table.column("doc_id").take(rows), pa.array(start[rows] + a), pa.array(b - a),
                pa.array(sums, pa.int64()), table.column("doc_tokens").take(rows),
                pa.array((np.int64(group) << 32) + s), pa.array(at)]
        return pa.Table.from_arrays(cols + [pa.array(cut, pa.binary())] * with_ids, names=names)

    schema = (f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint" + ", ids binary" * with_ids)
    return dealt.groupBy("grp").applyInArrow(pack, schema)
