"""Operator 2: SentencePiece encoding and decoding by shared-prefix Viterbi.

Every text is cut at its space marks.  The distinct marked words of a slice
of documents, sorted, are walked depth-first as a trie (``pieces.PieceModel``):
the forward scores of a shared prefix are computed once.  A BPE model admits
one path per word, so the best path is the library's own segmentation (a
plain best-sum-of-scores path over the same vocabulary is not).

Texts: null and empty give no ids; a run of spaces is one unit with what
follows it; characters without a piece become byte pieces.  Decoding gives
the text back, except that a literal U+2581 comes back as a space (as in the
library).  Rows are independent: repeated rows, ties and extra columns need
no rule, an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import MARK, PieceModel, load

#: texts of about this many characters are segmented together
SLICE_CHARS = 8_000_000
#: words whose segmentation a task remembers
REMEMBER = 400_000


def units(text: str) -> list[str]:
    """The marked words of a text, each without its first mark."""
    if not text:
        return []
    out = text.replace(MARK, " ").split(" ")
    if "" not in out:
        return out
    joined, run = [], 0
    for w in out:
        if w:
            joined.append(" " * run + w)
            run = 0
        else:
            run += 1
    if run:
        joined.append(" " * (run - 1))
    return joined


def slices(texts: list[str | None], limit: int = SLICE_CHARS):
    """(first, last) ranges of texts with about ``limit`` characters each."""
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Encoder:
    """Segments texts, remembering the ids of words (bounded)."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def _learn(self, words: set[str]) -> None:
        model, known = self.model, self.known
        plain = [MARK + w for w in words if w and w[0] != " "]
        for w, last, back, _, _ in model.walk(plain):
            known[w[1:]] = np.array(model.ids_of(w, last, back), np.int32).tobytes()
        for w in words:
            if not w or w[0] == " ":
                known[w] = np.array(model.merged_ids(MARK + w.replace(" ", MARK)), np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        split = [units(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = set(chain.from_iterable(split)).difference(self.known)
        self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def decode(model: PieceModel, ids) -> str:
    """The text of a sequence of ids."""
    table = model.decoded
    raw = b"".join([table[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(df: DataFrame, model_path: str, text_col: str = "text",
                     keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``n_tokens`` long, ``ids`` array<int> and ``round_trip``
    (the ids decode to the text) of every whole text."""
    spark = df.sparkSession
    keep = ["doc_id"] if keep is None else keep
    shared = spark.sparkContext.broadcast(load(model_path))  # one vocabulary: bounded
    source = df.select(*keep, df[text_col].cast("string").alias("_text"))
    n_keep = len(keep)

    def run(batches):
        model = shared.value
        encoder = Encoder(model)
        for batch in batches:
            texts = batch.column(n_keep).to_pylist()
            for a, b in slices(texts):
                coded = encoder.encode(texts[a:b])
                sizes = np.fromiter((len(c) // 4 for c in coded), np.int64, b - a)
                flat = np.frombuffer(b"".join(coded), np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                same = [decode(model, flat[x:y].tolist()) == (t or "")
                        for t, x, y in zip(texts[a:b], ends[:-1], ends[1:])]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in batch.columns[:n_keep]]
                    + [pa.array(sizes), ids, pa.array(same, pa.bool_())],
                    names=[*keep, "n_tokens", "ids", "round_trip"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, n_tokens bigint, ids array<int>, round_trip boolean")


def decode_documents(df: DataFrame, model_path: str, ids_col: str = "ids",
                     out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids in ``out_col`` (null ids: empty text)."""
    shared = df.sparkSession.sparkContext.broadcast(load(model_path))
    at = df.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            texts = [decode(shared.value, ids or ()) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, out_col])

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{cols}, `{out_col}` string")
