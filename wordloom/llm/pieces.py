"""SentencePiece BPE by dynamic programming over prefixes.

A BPE segmentation has a local test: a sequence of pieces is the segmentation
of its text exactly if every two neighbours keep their border when they are
merged on their own.  So every prefix of a word has exactly one admissible
last piece, and a forward pass that goes from prefix to prefix (a Viterbi
pass whose admissible path is unique) gives the ids, the score and the number
of pieces of *every* prefix.  Words sorted as strings are the depth-first
order of their trie: the pass for a word starts behind the prefix it shares
with the word before.

Nothing in the vocabulary crosses from a text character to a following space
mark (checked when a model is loaded), so texts are segmented word by word.
"""

from __future__ import annotations

import heapq

MARK = "▁"
UNKNOWN = -1


class _Node:
    """A state of the matcher: the longest suffix read that begins a piece."""

    __slots__ = ("text", "next", "ends")

    def __init__(self, text: str, ends: tuple):
        self.text, self.next, self.ends = text, {}, ends


class PieceModel:
    """Pieces of one SentencePiece BPE model (bounded by its vocabulary)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = special | set(self.bytes_id)
        self.ids = {sp.id_to_piece(i): i for i in range(n) if i not in skip}
        if any(MARK in p.lstrip(MARK) or MARK * 2 in p and p.strip(MARK) for p in self.ids):
            raise ValueError("a piece goes on behind a space; words cannot be segmented alone")
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        # what a piece decodes to
        back = {b: bytes([k]) for k, b in enumerate(self.bytes_id)}
        self.decoded = [b"" if i in special else back[i] if i in back
                        else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.split: dict[str, tuple[str, str]] = {}
        for p in sorted(self.rank, key=self.rank.get):
            got, last = self.merge(p)
            if got == [p]:
                self.split[p] = last
        # a piece that merging never forms cannot occur; runs of marks are merged by ``merge``
        self.with_runs = dict(self.ids)
        self.ids = {p: i for p, i in self.ids.items()
                    if (len(p) == 1 or p in self.split) and MARK * 2 not in p}
        for p in self.ids:
            if len(p) > 1:
                for part in self.split[p]:
                    if len(part) > 1 and self.rank[part] >= self.rank[p]:
                        raise ValueError("a piece ranks before one of its own parts")
        self.rank = {p: r for p, r in self.rank.items() if p in self.split}
        self._count_runs()
        self.text = {i: p for p, i in self.ids.items()}
        self.score = {i: sp.get_score(i) for i in self.text}
        self.starts = {p[:k] for p in self.ids for k in range(len(p) + 1)}
        self._reset()

    def _count_runs(self) -> None:
        """Pieces of a run of marks: the longest piece again and again, then a
        remainder.  Marks merge after everything else, so a run does not
        depend on the text behind it (both checked)."""
        runs = [p for p in self.rank if MARK * 2 in p]
        if runs and min(self.rank[p] for p in runs) <= max(
                (r for p, r in self.rank.items() if MARK * 2 not in p), default=0):
            raise ValueError("marks merge before a piece of text")
        self.longest_run = max(map(len, runs), default=1)
        self.run_rest = [len(self.merge(MARK * k)[0]) for k in range(self.longest_run)]
        if any(len(self.merge(MARK * k)[0]) != self.run_count(k) for k in range(4 * self.longest_run)):
            raise ValueError("runs of marks do not repeat")

    def run_count(self, marks: int) -> int:
        """Tokens of a run of marks."""
        return marks // self.longest_run + self.run_rest[marks % self.longest_run]

    def prefix_counts(self, marks: int, word: str) -> list[int]:
        """Tokens of the first 0, 1, 2 ... characters of ``marks`` marks and a
        word, from one forward pass."""
        out = [self.run_count(k) for k in range(marks + 1)]
        for _, _, back, count, _ in self.walk([MARK + word] if word else []):
            # where the first piece of every prefix ends; a lone mark belongs to the run
            first = [0, 1]
            for i in range(2, len(word) + 2):
                first.append(first[back[i]] if back[i] else i)
                alone = first[i] == 1
                out.append(self.run_count(marks - (not alone)) + count[i] - alone)
        return out

    def _reset(self) -> None:
        self.root = _Node("", ())
        self.nodes = {"": self.root}
        self.stable: dict[int, bool] = {}
        self.sides: dict[int, tuple] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items()
                if k not in ("root", "nodes", "stable", "sides")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    # -- plain merging, for the tables above and for runs of space marks ------

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge best pair first (ties: leftmost); the pieces and the last merge."""
        sym = list(text)
        prev, nxt = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        heap, last = [], None

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(sym):
                r = self.rank.get(sym[i] + sym[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, j, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or nxt[i] != j:
                continue
            sym[i], sym[j], nxt[i], last = a + b, "", nxt[j], (a, b)
            if nxt[j] < len(sym):
                prev[nxt[j]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return [s for s in sym if s], last

    # -- the local test --------------------------------------------------------

    def _side(self, piece: str, right: int) -> list[tuple[str, float]]:
        """The symbols at one end of a piece while it is formed, each with the
        rank of the merge that uses it up."""
        out, until = [], float("inf")
        while True:
            out.append((piece, until))
            if len(piece) == 1:
                return out
            until, piece = self.rank[piece], self.split[piece][right]

    def _keeps_border(self, a: int, b: int) -> bool:
        left = self.sides.get(2 * a) or self.sides.setdefault(2 * a, self._side(self.text[a], 1))
        right = (self.sides.get(2 * b + 1)
                 or self.sides.setdefault(2 * b + 1, self._side(self.text[b], 0)))
        rank = self.rank
        for x, x_until in left:
            for y, y_until in right:
                r = rank.get(x + y)
                # on equal ranks the leftmost merge goes first
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _step(self, node: _Node, c: str) -> _Node:
        s = node.text + c
        while s not in self.starts:
            s = s[1:]
        got = self.nodes.get(s)
        if got is None:
            ids = self.ids
            ends = tuple((len(s) - k, ids[s[k:]]) for k in range(len(s)) if s[k:] in ids)
            got = self.nodes[s] = _Node(s, ends)
        node.next[c] = got
        return got

    # -- forward passes --------------------------------------------------------

    def walk(self, words):
        """Depth-first over the trie of distinct one-mark words.

        Yields ``(word, last, back, count, score)``: for every prefix length
        the last piece (``UNKNOWN``: a character without a piece, spelled in
        bytes), where it starts, the exact number of tokens and the score.
        The lists are reused; read them before the next word.
        """
        nodes, last, back, count, score = [self.root], [0], [0], [0], [0.0]
        stable, piece_score = self.stable, self.score
        before = ""
        for w in sorted(words):
            k, top = 0, min(len(w), len(before))
            while k < top and w[k] == before[k]:
                k += 1
            del nodes[k + 1:], last[k + 1:], back[k + 1:], count[k + 1:], score[k + 1:]
            node = nodes[k]
            for i in range(k, len(w)):
                c = w[i]
                node = node.next.get(c) or self._step(node, c)
                for size, t in node.ends:
                    j = i + 1 - size
                    if j == 0 or (p := last[j]) == UNKNOWN:
                        break
                    key = (p << 24) | t
                    ok = stable.get(key)
                    if ok is None:
                        ok = stable[key] = self._keeps_border(p, t)
                    if ok:
                        break
                else:
                    t, j = UNKNOWN, i
                nodes.append(node)
                last.append(t)
                back.append(j)
                if t == UNKNOWN:
                    count.append(count[j] + len(c.encode()))
                    score.append(score[j])
                else:
                    count.append(count[j] + 1)
                    score.append(score[j] + piece_score[t])
            before = w
            yield w, last, back, count, score

    def ids_of(self, w: str, last, back) -> list[int]:
        """Ids of a word from the lists of ``walk``."""
        out, i = [], len(w)
        while i:
            t, j = last[i], back[i]
            if t == UNKNOWN:
                out.extend(self.bytes_id[b] for b in reversed(w[j:i].encode()))
            else:
                out.append(t)
            i = j
        out.reverse()
        return out

    def merged_ids(self, unit: str) -> list[int]:
        """Ids of a unit with a run of marks, by plain merging."""
        out = []
        for s in self.merge(unit)[0]:
            got = self.with_runs.get(s)
            out.extend([got] if got is not None else [self.bytes_id[b] for b in s.encode()])
        return out


def load(path: str) -> PieceModel:
    return PieceModel(path)
