"""Operator 9: personal data by rules and a linear-chain CRF.

The base finds e-mail, IP, card and phone numbers by pattern and check.  The
method adds spans: a linear-chain conditional random field over word shapes,
trained on the small table of ``pii_labels`` (maximum likelihood, on the
driver, a few hundred words), decoded by Viterbi over whole texts in numpy,
all lines of a slice at once.  It finds what the patterns lose, such as a
phone number or a card that runs into the next number.  Spans that touch a
base span are left to the base.

Features are computed for all words at once from the array of code points:
counts of digits, letters, signs, the outline of the number, two checks
(Luhn, dotted quad), and the same of both neighbours.

Defined results: a null or empty text has no spans; offsets are code points,
end exclusive; rows are independent, so repeated rows, ties and an empty table
need no rule; extra columns are not touched.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_labels
from .scratch import quoted, unused
from .sentencepiece_codec import slices

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS]

# -- base ----------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always starts where its run of digits starts
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        # no local part goes over a sign that was looked at
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in the order of ``KINDS``."""
    ips = [m.span() for m in _IP.finditer(text)
           if all(len(p) < 4 and int(p) <= 255 or not p.strip("0") or
                  len(p.lstrip("0")) < 4 and int(p.lstrip("0")) <= 255 for p in m.group().split("."))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                cards.append(m.span())
    phones = ([m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
              if "+" in text else [])
    return [_emails(text), ips, cards, phones]


# -- word shapes ---------------------------------------------------------------

SPACE, DIGIT, LETTER, AT, DOT, DASH, PLUS, PAREN, SIGN = range(9)
_CLASS = np.full(129, SIGN, np.uint8)
for _chars, _c in (("\t\n\x0b\x0c\r ", SPACE), ("0123456789", DIGIT), ("@", AT), (".", DOT),
                   ("-", DASH), ("+", PLUS), ("()", PAREN),
                   ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER)):
    for _ch in _chars:
        _CLASS[ord(_ch)] = _c
_CLASS[128] = LETTER


def _buckets(*starts: int) -> np.ndarray:
    """Count -> bucket, for counts up to 24 (higher ones go with 24)."""
    return np.searchsorted(np.array(starts), np.arange(25), side="right").astype(np.int64)


_DIGITS = _buckets(1, 2, 3, 4, 5, 8, 12, 15, 16, 20)      # 11 values
_LETTERS = _buckets(1, 2, 4)                              # 4
_FEW = _buckets(1, 2, 3)                                  # 4
_DOTS = _buckets(1, 2, 3, 4)                              # 5
#: values of each feature of one word
_SIZES = [11, 4, 4, 5, 4, 2, 4, 4, 6, 11 * 4, 11 * 5, 11]
#: the word itself has all features, its neighbours the number's outline only
_NEAR = [0, 8]


class Words:
    """The words of some texts, with the numbers of their features."""

    def __init__(self, texts: list[str]):
        # texts are lines of one array; a text's own line ends separate its lines
        joined = "\n".join(texts)
        self.points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = _CLASS[np.minimum(self.points, 128)]
        inside = np.concatenate([[False], classes != SPACE, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        breaks = np.flatnonzero(self.points == 10)
        self.line = np.searchsorted(breaks, self.starts)
        self.joined = joined
        self._features(classes)

    def _features(self, classes: np.ndarray) -> None:
        n = len(self.starts)
        self.size = n
        if not n:
            return
        def count(c):
            return np.minimum(np.add.reduceat((classes == c).view(np.int8), self.starts,
                                              dtype=np.int32), 24)
        digits, letters, dots = count(DIGIT), count(LETTER), count(DOT)
        first = self.points[self.starts]
        check = np.zeros(n, np.int64)
        self.digits = digits
        # outline of a number: 0 none, 1 number, 2 Luhn number, 3 dotted quad, 4 failed quad, 5 digits and letters
        check[digits > 0] = 1
        check[(digits > 0) & (letters > 0)] = 5
        for i in np.flatnonzero((digits >= 12) & (letters == 0)):
            d = _digits(self.word(i))
            if 12 <= len(d) <= 19 and luhn(d):
                check[i] = 2
        for i in np.flatnonzero((dots >= 3) & (digits >= 4) & (letters == 0)):
            m = _IP.search(self.word(i))
            check[i] = 3 if m and all(int(p) <= 255 for p in m.group().split(".") if len(p) < 6) \
                and max(map(len, m.group().split("."))) < 6 else 4
        d, x = _DIGITS[digits], _LETTERS[letters]
        self.columns = [
            d, x, _FEW[count(AT)], _DOTS[dots], _FEW[count(DASH)],
            (first == 43).astype(np.int64), _FEW[count(PAREN)], _FEW[count(SIGN)],
            check, d * 4 + x, d * 5 + _DOTS[dots],
            _DIGITS[np.minimum(self.ends - self.starts, 24)]]

    def word(self, i: int) -> str:
        return self.joined[self.starts[i]:self.ends[i]]

    def feature_ids(self) -> list[np.ndarray]:
        """Rows of the weight matrix that each word adds up."""
        out, base = [], 0
        for col, size in zip(self.columns, _SIZES):
            out.append(col + base)
            base += size
        for f in _NEAR:
            for step in (-1, 1):
                near = np.full(self.size, _SIZES[f], np.int64)  # no neighbour in the line
                if step < 0:
                    same = self.line[1:] == self.line[:-1]
                    near[1:][same] = self.columns[f][:-1][same]
                else:
                    same = self.line[1:] == self.line[:-1]
                    near[:-1][same] = self.columns[f][1:][same]
                out.append(near + base)
                base += _SIZES[f] + 1
        return out


N_FEATURES = sum(_SIZES) + 2 * sum(_SIZES[f] + 1 for f in _NEAR)


# -- the random field ----------------------------------------------------------


class Field:
    """Linear-chain CRF: a weight row for every feature value, a transition
    matrix and start weights."""

    def __init__(self):
        k = len(LABELS)
        self.weights = np.zeros((N_FEATURES, k), np.float64)
        self.moves = np.zeros((k, k))
        self.start = np.zeros(k)

    def emissions(self, words: Words) -> np.ndarray:
        ids = words.feature_ids()
        out = self.weights[ids[0]]
        for f in ids[1:]:
            out += self.weights[f]
        return out

    def fit(self, lines: list[str], rounds: int = 250, rate: float = 0.15, decay: float = 2e-3):
        """Maximum likelihood by gradient ascent with per-weight steps (Adagrad)."""
        parsed = [pii_labels.parse(x) for x in lines]
        words = Words([t for t, _ in parsed])
        gold = np.zeros(words.size, np.int64)
        at = 0
        for text, spans in parsed:
            for kind, a, b in spans:
                gold[(words.starts < at + b) & (words.ends > at + a)] = LABELS.index(kind)
            at += len(text) + 1
        ids = words.feature_ids()
        cuts = [0, *(np.flatnonzero(np.diff(words.line)) + 1), words.size]
        k = len(LABELS)
        seen = [np.zeros_like(self.weights), np.zeros_like(self.moves), np.zeros_like(self.start)]
        for _ in range(rounds):
            grads = [-decay * self.weights, -decay * self.moves, -decay * self.start]
            scores = self.emissions(words)
            for a, b in zip(cuts[:-1], cuts[1:]):
                e = scores[a:b]
                fwd, bwd = np.empty_like(e), np.zeros_like(e)
                fwd[0] = self.start + e[0]
                for t in range(1, b - a):
                    fwd[t] = e[t] + np.logaddexp.reduce(fwd[t - 1][:, None] + self.moves, axis=0)
                for t in range(b - a - 2, -1, -1):
                    bwd[t] = np.logaddexp.reduce(self.moves + (e[t + 1] + bwd[t + 1])[None, :], axis=1)
                total = np.logaddexp.reduce(fwd[-1])
                diff = np.eye(k)[gold[a:b]] - np.exp(fwd + bwd - total)
                for f in ids:
                    np.add.at(grads[0], f[a:b], diff)
                grads[2] += diff[0]
                for t in range(1, b - a):
                    pair = np.exp(fwd[t - 1][:, None] + self.moves + (e[t] + bwd[t])[None, :] - total)
                    grads[1] -= pair
                    grads[1][gold[a + t - 1], gold[a + t]] += 1
            for w, g, s in zip((self.weights, self.moves, self.start), grads, seen):
                s += g * g
                w += rate * g / np.sqrt(s + 1e-8)
        return self

    def decode(self, words: Words) -> np.ndarray:
        """The best label of every word; all lines step forward together."""
        best = np.zeros(words.size, np.uint8)
        if not words.size:
            return best
        scores = self.emissions(words).astype(np.float32)
        moves = self.moves.astype(np.float32)
        first = np.concatenate([[0], np.flatnonzero(np.diff(words.line)) + 1])
        length = np.diff(np.concatenate([first, [words.size]]))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        # open_at[t]: lines that have a word number t
        open_at = np.searchsorted(-length, -np.arange(length[0]), side="left")
        back = np.empty((words.size, len(LABELS)), np.uint8)
        state = scores[first] + self.start.astype(np.float32)
        for t in range(1, int(length[0])):
            n = int(open_at[t])
            at = first[:n] + t
            step = state[:n, :, None] + moves
            back[at] = step.argmax(axis=1)
            state[:n] = step.max(axis=1) + scores[at]
        label = state.argmax(axis=1)
        for t in range(int(length[0]) - 1, -1, -1):
            n = int(open_at[t])
            at = first[:n] + t
            best[at] = label[:n]
            if t:
                label[:n] = back[at, label[:n]]
        return best


# -- spans ---------------------------------------------------------------------

_EDGE = {"email": re.compile(r"[A-Za-z0-9].*[A-Za-z0-9]", re.S),
         "ip": re.compile(r"[0-9].*[0-9]", re.S), "card": re.compile(r"[0-9].*[0-9]", re.S),
         "phone": re.compile(r"[+(]?[0-9].*[0-9]", re.S)}


def _sound(kind: str, s: str) -> bool:
    """What a span of the field must hold to be reported."""
    d = _digits(s)
    if kind == "email":
        return "@" in s
    if kind == "ip":
        return s.count(".") == 3 and all(p.isdecimal() and len(p) < 4 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15


def _field_spans(words: Words, labels: np.ndarray):
    """(kind number, start, end) in the joined text, runs of one label joined."""
    hot = np.flatnonzero(labels)
    out = []
    run: list[int] = []

    def close():
        if not run:
            return
        kind = LABELS[labels[run[0]]]
        # every whole card, address or mailbox word stands alone; a phone number has several words
        groups = [[i] for i in run] if kind != "phone" and (
            kind != "card" or all(words.digits[i] >= 12 for i in run)) else [run]
        for g in groups:
            a, b = int(words.starts[g[0]]), int(words.ends[g[-1]])
            m = _EDGE[kind].search(words.joined, a, b)
            if m and _sound(kind, m.group()):
                out.append((KINDS.index(kind), m.start(), m.end()))

    for i in hot:
        if run and (i != run[-1] + 1 or labels[i] != labels[run[-1]] or words.line[i] != words.line[run[-1]]):
            close()
            run = []
        run.append(int(i))
    close()
    return out


def find(field: Field, texts: list[str]) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """For each text the base spans and all spans, by kind."""
    words = Words(texts)
    added = _field_spans(words, field.decode(words)) if words.size else []
    out, at, k = [], 0, 0
    added.sort(key=lambda s: s[1])
    for text in texts:
        base = base_spans(text)
        every = [list(s) for s in base]
        end = at + len(text)
        taken = sorted(s for spans in base for s in spans)
        while k < len(added) and added[k][1] < end:
            kind, a, b = added[k]
            a, b, k = a - at, b - at, k + 1
            if not any(x < b and a < y for x, y in taken):
                every[kind].append((a, b))
        out.append((base, [sorted(s) for s in every]))
        at = end + 1
    return out


def _joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, s in zip(KINDS, spans) for a, b in s)


def trained(lines: list[str] | None = None) -> Field:
    return Field().fit(pii_labels.TRAIN if lines is None else lines)


def find_documents(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                   lines: list[str] | None = None) -> DataFrame:
    """``keep`` columns, counts and digest of the base spans, and all spans."""
    keep = ["doc_id"] if keep is None else keep
    field = df.sparkSession.sparkContext.broadcast(trained(lines))  # N_FEATURES x 5 weights
    source = df.select(*keep, F.coalesce(df[text_col].cast("string"), F.lit("")).alias("_text"))
    n_keep = len(keep)

    def run(batches):
        for batch in batches:
            texts = batch.column(n_keep).to_pylist()
            for a, b in slices(texts, 4_000_000):
                found = find(field.value, texts[a:b])
                base = [_joined(x) for x, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in batch.columns[:n_keep]]
                    + [pa.array([len(x[k]) for x, _ in found], pa.int64()) for k in range(4)]
                    + [pa.array([hashlib.sha256(s.encode()).hexdigest() for s in base], pa.string()),
                       pa.array([_joined(x) for _, x in found], pa.string())],
                    names=[*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, kept + ", " + ", ".join(f"n_{k} bigint" for k in KINDS)
                             + ", base_sha256 string, spans string")


def mask(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """``text`` with every span replaced by its kind; overlaps go as one piece."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, s in zip(KINDS, spans) for a, b in s):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(df: DataFrame, text_col: str = "text", lines: list[str] | None = None) -> DataFrame:
    """``df`` with the personal data of ``text_col`` masked (null stays null)."""
    field = df.sparkSession.sparkContext.broadcast(trained(lines))
    others = [c for c in df.columns if c != text_col]
    # the other columns travel as one, whatever their names are
    held = df.select(F.struct(F.lit(0).alias(unused(df, "_")[0]), *[F.col(quoted(c)) for c in others]).alias("held"),
                     F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 4_000_000):
                part = texts[a:b]
                found = find(field.value, [t or "" for t in part])
                clean = [None if t is None else mask(t, every) for t, (_, every) in zip(part, found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(clean, pa.string())],
                                                 names=["held", "text"])

    out = held.mapInArrow(run, held.schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"held.{quoted(c)}") for c in df.columns])
