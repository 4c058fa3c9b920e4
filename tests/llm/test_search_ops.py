"""Lexical search, substring dedup and spelling variants against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import lexical_search, spelling, substring_dedup

SCHEMA = "doc_id long, text string, score string, n_words string, `a.b` int"


def passages(seed=3):
    """Texts with shared passages, copies, self-repetition, hot passages and edge rows."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "a'b", " x"]
    draw = lambda n: [words[i] for i in rng.integers(0, len(words), n)]
    shared = [draw(int(rng.integers(8, 60))) for _ in range(6)]
    docs = []
    for i in range(90):
        body = draw(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = shared[int(rng.integers(0, 6)) if i % 3 else 0]
        docs.append(" ".join(body) if i % 2 else "\n".join(body) + "\t")
    docs += docs[:4] + [None, "", " \n\x0b", "x", " ".join(["tick"] * 50), " ".join(draw(40) * 3), "w1 " * 5000]
    rows = [(i, t, "s", "n", 1) for i, t in enumerate(docs)]
    return rows + [(None, docs[0], "s", "n", 1), (None, docs[1], "s", "n", 1), (7, docs[9], "s", "n", 1), rows[5]]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(passages(), SCHEMA).repartition(5).cache()


def brute_windows(rows, size):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[a:a + size]) for w in lists for a in range(len(w) - size + 1))
    out = []
    for r, w in zip(rows, lists):
        gone = {k for a in range(len(w) - size + 1) if seen[tuple(w[a:a + size])] > 1 for k in range(a, a + size)}
        out.append((r[0], " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return Counter(out)


@pytest.mark.parametrize("size,hot,shard,block", [(12, 256, 150_000, 4_000_000), (12, 1, 3000, 64), (35, 2, 4000, 400)])
def test_substring_dedup_against_all_windows(texts, monkeypatch, size, hot, shard, block):
    monkeypatch.setattr(substring_dedup, "HOT_PIECES", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    out = substring_dedup.dedup_documents(texts, size)
    assert out.columns == ["doc_id", "text", "score", "a.b", "n_words", "n_removed"]
    want = brute_windows(passages(), size)
    assert sum(k[3] for k in want) > 500 and any(k[3] == 0 < k[2] for k in want)
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()) == want
    assert substring_dedup.dedup_documents(texts.limit(0), size).count() == 0


def test_common_passage_makes_two_rows_a_piece_and_round(spark, monkeypatch):
    """A passage in many surroundings is not written window by window."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(45)]
    own = [[f"u{i}" for i in rng.integers(0, 10**6, 60)] for _ in range(60)]
    rows = [(i, " ".join(w[:30] + passage + w[30:]), "s", "n", 1) for i, w in enumerate(own)]
    written, stash = defaultdict(list), substring_dedup.stash

    def counted(df, name):
        out = stash(df, name)
        written[name].append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "stash", counted)
    monkeypatch.setattr(substring_dedup, "HOT_PIECES", 8)
    out = substring_dedup.dedup_documents(spark.createDataFrame(rows, SCHEMA), 35)
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()) == brute_windows(rows, 35)
    hot = sum(written["sub-hot"])
    assert hot >= 60 and max(n for name, c in written.items() if name not in ("sub-runs", "sub-some") for n in c) <= 2 * hot


def test_automaton_counts_like_plain_search():
    rng = np.random.default_rng(1)
    lists = [(list(rng.integers(0, 3, int(rng.integers(1, 40)))), int(rng.integers(1, 4))) for _ in range(20)]
    automaton = substring_dedup.Automaton()
    for words, weight in lists:
        automaton.add(words, weight)
    automaton.close(4)

    def count(s):
        return sum(w * sum(x[a:a + len(s)] == s for a in range(len(x) - len(s) + 1)) for x, w in lists)
    for words in [x for x, _ in lists] + [list(rng.integers(0, 4, 60))]:
        for end, size in enumerate(automaton.matches(words), 1):
            assert size == max(k for k in range(end + 1) if k == 0 or count(words[end - k:end]) >= 4)


def test_spans_shared_with_a_reference(texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 100)
    rows = passages()
    reference = [rows[3][1], None, rows[30][1], "no such words here"]
    want = defaultdict(set)
    known = {tuple(w[a:a + 10]) for w in (re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in reference)
             for a in range(len(w) - 9)}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        for a in range(len(w) - 9):
            if tuple(w[a:a + 10]) in known:
                want[-2**63 if r[0] is None else r[0]].update(range(a, a + 10))
    got = defaultdict(set)
    for r in substring_dedup.matched_spans(texts, reference, 10, max_words=2000).collect():
        for s in r.spans:
            got[r.doc].update(range(s.a, s.b))
    assert got == want and len(want) > 3
    with pytest.raises(ValueError):
        substring_dedup.matched_spans(texts, reference, 10, max_words=5)


def brute_search(rows, items, k):
    def terms(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    sizes = [sum(c.values()) for _, c in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in set(items):
        scores = []
        for (doc_id, c), size in zip(docs, sizes):
            s = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    s += w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // total)))
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("chunk,block", [(4_000_000, 4_000_000), (60, 9000)])
def test_lexical_search_against_all_scores(spark, texts, monkeypatch, chunk, block):
    monkeypatch.setattr(lexical_search, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(lexical_search, "PART", 50)
    rows = passages()
    items = [(i, rows[i * 5][1]) for i in range(12)] + [(50, None), (51, ""), (52, "none such"), (53, "W1 ünï a'b"),
                                                       (53, "w2"), (None, "tick x"), (53, "w2")]
    table = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, rank string")
    monkeypatch.setattr(lexical_search.item_blocks, "__defaults__", (block,))
    for k in (3, 10):
        got = Counter(map(tuple, lexical_search.search(texts, table, k).collect()))
        assert got == brute_search(rows, items, k) and len(got) > 30
    assert lexical_search.search(texts.limit(0), table).count() == 0
    assert lexical_search.search(texts, table.limit(0)).count() == 0


def test_accumulators_stop_and_stay_exact():
    rng = np.random.default_rng(2)
    size, n = 12, 400
    chunk = lexical_search.Chunk(size)
    for d in range(n):
        chunk.add(d, 20, np.array([1 + int(t) for t in rng.geometric(0.35, 20) if t < size], np.int64))
    weights = np.array([0, *(200 * k for k in range(1, size))])
    chunk.invert(weights, n, 20 * n)
    full = np.zeros(n, np.int64)
    words = list(range(size - 1, 0, -1))
    for w in words:
        a, b = chunk.start[w], chunk.start[w + 1]
        full[chunk.doc[a:b]] += chunk.score[a:b]
    found = chunk.search(words, 5, 0)
    assert sorted((s for s, _ in found), reverse=True)[:5] == sorted(full.tolist(), reverse=True)[:5]
    assert all(full[d] == s for s, d in found) and not chunk.made.any() and not chunk.total.any()
    assert chunk.search(words, 5, int(full.max()) + 1) == []


def brute_spelling(rows, ratio=5):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    partners = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        if partners[w]:
            top = min(partners[w], key=lambda v: (-words[v], v))
            if words[top] >= ratio * n:
                form[w] = top
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(partners[w]), form.get(w), words.get(form.get(w)), root))
    return Counter(out)


def test_spelling_variants_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows, letters = [], "abé×"
    for i in range(150):
        words = []
        for _ in range(300):
            w = "".join(letters[k] for k in rng.integers(0, len(letters), 6))[:int(rng.integers(5, 8))]
            if rng.random() < 0.5:
                w = ["station", "stations", "sttion", "stattion", "Nation×l", "aaaaaaa", "štation"][
                    min(6, int(rng.geometric(0.55)) - 1)]
            words.append(w)
        rows.append((i if i % 7 else None, " ".join(words), "s"))
    rows += [(1, None, "s"), (2, "", "s"), (3, "longword " * 30_000, "s"), rows[3]]
    rows += [(1000 + k, "marker marked " + "marke " * (k % 2) + "x×y" * 3 + " \U0001F600sixsix", "s") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(4)
    out = spelling.variant_groups(spelling.word_counts(df))
    want = brute_spelling(rows)
    got = Counter((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in out.collect())
    assert got == want
    assert sum(k[3] is not None for k in want) >= 2 and len(want) > 100
    assert spelling.variant_groups(spelling.word_counts(df.limit(0))).count() == 0


def test_chains_of_forms_reach_their_root(spark):
    chain = [("a" * 6 + "b" * k, 5 * 5 ** k) for k in range(11)]
    words = spark.createDataFrame(chain + [("zzzzzz", 5)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variant_groups(words).collect()}
    for (w, _), (v, _) in zip(chain, chain[1:]):
        assert got[w][:2] == (v, chain[-1][0])
    assert got[chain[-1][0]] == (None, chain[-1][0], 1) and got["zzzzzz"] == (None, "zzzzzz", 0)


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    words = sorted({"".join("abé"[k] for k in rng.integers(0, 3, int(rng.integers(2, 10)))) for _ in range(700)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = Counter((r.word, r.near) for r in spelling.near_pairs(df).collect())
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, F.levenshtein("a.word", "b.word") == 1).select("a.word", "b.word").collect()
    assert got == Counter(map(tuple, want)) and len(got) > 1000
