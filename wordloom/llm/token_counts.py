"""Operator 4: token counts by prefix dynamic programming.

The forward pass of ``pieces`` stores the exact number of tokens of every
prefix of a word; words do not influence each other, so the count of any
prefix of a text is a sum of word counts and one stored prefix count.  Behind
a run of spaces the run and the word are counted apart (the model merges marks
last), so a unit of any length takes one pass.  The longest prefix within a budget is read off those numbers; nothing is encoded
again.

Texts: null counts as empty (0 bytes, 0 tokens).  Rows are independent:
repeated rows, ties and extra columns need no rule, an empty table gives an
empty table.  A literal U+2581 is the model's space mark, as in the library.
"""

from __future__ import annotations

from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import MARK, PieceModel, load
from .sentencepiece_codec import REMEMBER, slices, units


class Counter:
    """Counts tokens of texts and of their prefixes, remembering words (bounded)."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def _learn(self, words: set[str]) -> None:
        known = self.known
        for w, _, _, count, _ in self.model.walk([MARK + w for w in words if w and w[0] != " "]):
            known[w[1:]] = count[-1]
        for w in words:
            if not w or w[0] == " ":
                known[w] = self._merged(w)

    def _merged(self, unit: str) -> int:
        return len(self.model.merged_ids(MARK + unit.replace(" ", MARK)))

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """The units of each text, all of them counted."""
        split = [units(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        self._learn(set(chain.from_iterable(split)).difference(self.known))
        return split

    def total(self, words: list[str]) -> int:
        return sum(map(self.known.__getitem__, words))

    def prefix_counts(self, unit: str) -> list[int]:
        """Tokens of the first 0, 1, 2 … characters of a marked unit."""
        word = unit.lstrip(" ")
        return self.model.prefix_counts(1 + len(unit) - len(word), word)

    def fitting(self, words: list[str], limit: int) -> int:
        """Characters of the longest prefix of the text with at most ``limit`` tokens."""
        if limit <= 0:
            return 0
        before = chars = 0
        ends = list(accumulate(map(self.known.__getitem__, words)))
        # every unit adds a token: the prefix ends in the last unit that starts below the limit
        at = sum(1 for e in ends if e < limit)
        if at >= len(words):
            at = len(words) - 1
        if at < 0:
            return 0
        before = ends[at - 1] if at else 0
        chars = sum(map(len, words[:at])) + max(0, at - 1)
        unit, room = words[at], limit - before
        best = max(k for k, c in enumerate(self.prefix_counts(unit)) if c <= room)
        # ``best`` counts the unit's own mark: a space of the text, but for the first unit
        return chars + (best if at else max(0, best - 1))


def count_documents(df: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens``, ``over_limit`` and
    ``fit_chars`` (code points of the longest prefix within ``limit`` tokens)
    of every whole text."""
    keep = ["doc_id"] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(load(model_path))  # one vocabulary: bounded
    source = df.select(*keep, df[text_col].cast("string").alias("_text"))
    n_keep = len(keep)

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column(n_keep).to_pylist()
            for a, b in slices(texts):
                part = texts[a:b]
                split = counter.words(part)
                totals = [counter.total(ws) for ws in split]
                fits = [len(t or "") if n <= limit else counter.fitting(ws, limit)
                        for t, ws, n in zip(part, split, totals)]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in batch.columns[:n_keep]]
                    + [pa.array([len((t or "").encode()) for t in part], pa.int64()),
                       pa.array(totals, pa.int64()),
                       pa.array([n > limit for n in totals], pa.bool_()),
                       pa.array(fits, pa.int64())],
                    names=[*keep, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(
        run, f"{kept}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")
