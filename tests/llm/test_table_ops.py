"""Search, filters, dedup and join operators against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import catalog, jaccard_join, line_dedup, pii, quality_rules, topk_search, url_filter

SF001 = "/root/testdata/sf0.001"


def near_copies(seed=5):
    """Documents with exact copies, chains of near copies, shared lines and edge rows."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):
        base = [words[i] for i in rng.integers(0, 400, 60)]
        for _ in range(int(rng.integers(1, 30))):
            w = list(base)
            for k in rng.integers(0, len(w), rng.integers(0, 9 if g % 2 else 3)):
                w[k] = words[rng.integers(0, 400)]
            docs.append(" ".join(w[:30]) + "\n" + " ".join(w[30:]))
    docs += docs[:5] + [None, "", "  \n\t", "a b", "a b", "a  b\n", "one\ntwo\none", "w1 " * 4000, "the\n" * 300]
    return [(i, t, "src", "clash") for i, t in enumerate(docs)] + [(None, docs[0], "src", "clash")]


SCHEMA = "doc_id long, text string, source string, n_links string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(near_copies(), SCHEMA).repartition(5).cache()


def brute_lines(rows):
    seen, cut = [], defaultdict(list)
    key = lambda r: -2**63 if r[0] is None else r[0]
    for r in sorted(rows, key=key):
        for k, line in enumerate((r[1] or "").split("\n")):
            w = frozenset(line.split())
            if not w:
                continue
            if any(9 * len(w & v) >= 4 * (len(w) + len(v)) for v in seen):
                cut[key(r)].append(k)
            seen.append(w)
    return cut


def test_line_dedup_against_all_pairs(docs):
    cut = brute_lines(near_copies())
    for r in line_dedup.judged_documents(docs).collect():
        assert r.removed == cut[-2**63 if r.doc_id is None else r.doc_id]
        assert r.n_removed == len(r.removed)
    kept = {r.doc_id: r.text for r in line_dedup.dedup_documents(docs).collect()}
    for i, t, *_ in near_copies():
        lines = [x for k, x in enumerate((t or "").split("\n")) if k not in cut[-2**63 if i is None else i]]
        if cut[-2**63 if i is None else i] and not "".join(lines).strip():
            assert i not in kept
        else:
            assert kept[i] == (None if t is None else "\n".join(lines))


def test_line_dedup_tells_rows_with_one_id_apart(spark):
    rows = [(None, "one a b c\ntwo d e f\none a b c"), (None, "p q r s\nt u v w\nonly x y z"),
            (None, "k l m n\nt u v w"), (7, "g1 g2 g3\nt u v w"), (7, "h1 h2 h3\nh4 h5 h6"), (7, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in line_dedup.dedup_documents(df).collect()}
    assert {(None, "one a b c\ntwo d e f"), (7, "g1 g2 g3"), rows[4], rows[5], rows[6]} < kept
    a, b = {rows[1], (None, "k l m n")}, {rows[2], (None, "p q r s\nonly x y z")}
    assert len(kept) == 7 and (a < kept or b < kept)
    assert sorted(r.n_removed for r in line_dedup.judged_documents(df).collect()) == [0, 0, 0, 0, 1, 1, 1]


def test_line_sets_equal_plain_sets(monkeypatch):
    rng = random.Random(5)
    seps, words = [" ", "  ", "\t", "\x0b", "\r", "\n", "\n\n"], [f"w{k}" for k in range(30)] + ["\u00e9", "\u4e2d\u6587", "x" * 400, "\x1c", "\u00a0"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += [None, "", "\n", " \t", "a", "\na b\n\n c"]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "row": [0] * len(texts), "text": texts})
    want = {}
    for d, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if ws := frozenset(re.findall(r"[^\x20\x09-\x0D]+", line)):
                want[d, k] = ws
    classes = np.random.default_rng(1).integers(0, 9, line_dedup.CELLS).astype(np.uint8)
    for block in (1 << 18, 300, 1):  # also texts cut between their lines
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        hashed = line_dedup.Words()
        found = [line_dedup._sets(hashed, classes, p) for p in line_dedup._pieces([batch])]
        rows = {(r["doc"], r["line"]): r for b in found if b is not None for r in b.to_pylist()}
        assert rows.keys() == want.keys()
        groups = defaultdict(set)
        for at, ws in want.items():
            r, n = rows[at], len(ws)
            assert r["n"] == n and len(r["prefix"]) == (0 if n < 4 else n - -(-4 * n // 5) + 1)
            assert r["prefix"] == sorted(set(r["prefix"]))
            groups[r["f1"], r["f2"], tuple(r["prefix"]), r["w0"], r["w1"]].add(ws)
        assert len(groups) == len(set(want.values())) and all(len(g) == 1 for g in groups.values())


def test_line_dedup_runs_no_python(docs, monkeypatch):
    plans, stash = [], line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df, name: (plans.append(df), stash(df, name))[1])
    plans += [line_dedup.judged_documents(docs), line_dedup.dedup_documents(docs)]
    assert len(plans) > 10
    for df in plans:
        assert not re.search("Arrow|Python|Pandas", df._jdf.queryExecution().optimizedPlan().toString())


def test_native_line_sets_equal_plain_sets(spark):
    rng = random.Random(5)
    seps, words = [" ", "  ", "\t", "\x0b", "\x0c", "\r", "\n", "\n\n"], [f"w{k}" for k in range(30)] + ["\u00e9", "x" * 400, "\x1c", "\u00a0"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += [None, "", "\n", " \t", "a", "\na b\n\n c", "a\tb c d\x0be"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(d, k): ws for d, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))
            if (ws := frozenset(re.findall(r"[^\x20\x09-\x0D]+", line)))}
    classes = line_dedup.rarity_classes(df, "text")
    rows = {(r.doc, r.line): r for r in line_dedup.line_sets(line_dedup._lines(df, "text", "doc_id"), classes).collect()}
    assert rows.keys() == want.keys()
    groups = defaultdict(set)
    for at, ws in want.items():
        r, n = rows[at], len(ws)
        assert r.n == n and r.prefix == sorted(set(r.prefix))
        assert len(r.prefix) == (0 if n < 4 else n - -(-4 * n // 5) + 1)
        groups[r.f1, r.f2, tuple(r.prefix), r.w0, r.w1].add(ws)
    assert len(groups) == len(set(want.values())) and all(len(g) == 1 for g in groups.values())
    for a, v in want.items():
        for b, w in want.items():
            x, y = rows[a], rows[b]
            differ = sum(((i ^ j) & (1 << 64) - 1).bit_count() for i, j in ((x.w0, y.w0), (x.w1, y.w1)))
            assert differ <= len(v ^ w)


def test_line_dedup_splits_no_text_in_vain(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for k in range(40):  # sets of words on both sides of LONG, and their near copies
        words = [f"k{k}w{i}" for i in range(line_dedup.LONG + rng.randrange(-12, 30))]
        rows.append((3 * k, " ".join(words) + "\nx y z\n"))
        rows.append((3 * k + 1, " ".join(rng.sample(words, len(words) - rng.randrange(26)))))
        rows.append((3 * k + 2, "\t".join(words[rng.randrange(20):] + [f"n{i}" for i in range(rng.randrange(8))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plans, stash = {}, line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df, name: (plans.setdefault(name, df), stash(df, name))[1])
    cut = brute_lines(rows)
    assert 60 < sum(map(len, cut.values())) < 120
    for r in line_dedup.judged_documents(df).collect():
        assert r.removed == cut[r.doc_id]
    plans = {name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in plans.items()}
    # texts are not searched by patterns, and only documents with a line to verify are split
    assert not any("RLIKE" in p.upper() for p in plans.values())
    assert "scalar-subquery" in plans["line-texts"].partition("Generate ")[2]


def test_line_dedup_empty_table(docs):
    assert line_dedup.judged_documents(docs.limit(0)).count() == 0
    assert line_dedup.dedup_documents(docs.limit(0)).columns == docs.columns


def brute_join(rows):
    def grams(t):
        w = (t or "").split()
        return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    sets = {i: grams(t) for i, t, *_ in rows if i is not None}
    classes = defaultdict(list)
    for i, s in sets.items():
        if s:
            classes[s].append(i)
    links, up = Counter(), {min(v): min(v) for v in classes.values()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    items = [(min(v), s) for s, v in classes.items()]
    for n, (a, s) in enumerate(items):
        for b, v in items[:n]:
            if 5 * len(s & v) >= 4 * len(s | v):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    out = {}
    for i, s in sets.items():
        c = min(classes[s]) if s else i
        out[i] = (c, links[c], root(c) if s else i)
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_jaccard_join_against_all_pairs(docs, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    rows = jaccard_join.join_documents(docs).collect()
    want = brute_join(near_copies())
    assert sum(v[1] for v in want.values()) > 50
    for r in rows:
        if r.doc_id is not None:
            assert (r.class_id, r.n_links, r.group_id) == want[r.doc_id]
    assert len(rows) == len(near_copies())


def test_jaccard_keep_one(docs):
    kept = [r.doc_id for r in jaccard_join.keep_one(docs).collect()]
    want = {v[2] for v in brute_join(near_copies()).values()}
    assert sorted(k for k in kept if k is not None) == sorted(want)
    assert jaccard_join.join_documents(docs.limit(0)).count() == 0


def test_jaccard_keep_one_where_texts_share_an_id(spark):
    def text(name, changed=0):
        return " ".join(f"{name}{k}" if k >= changed else f"{name}new{k}" for k in range(60))
    rows = [(None, text("a")), (None, text("a", 2)), (None, text("b")), (None, text("b") + " "), (None, ""), (None, ""),
            (None, None), (3, text("c")), (5, text("c", 2)), (5, text("d")), (5, text("e")), (5, text("e", 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.keep_one(df).collect()
    assert Counter((r.doc_id, (r.text or "").strip()[:1], r.text is None) for r in kept) == Counter(
        [(None, "a", False), (None, "b", False), (None, "", False), (None, "", True), (3, "c", False),
         (5, "d", False), (5, "e", False)])


def test_bayesian_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard_join.least_matches(0.8)
    assert all(0 < k < 0.8 * h for h, k in least.items())
    a = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = (jaccard_join.min_hashes(a[:360]) == jaccard_join.min_hashes(a[40:])).mean()
    assert abs(same - 320 / 400) < 0.1


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [-1.0, 0.5]), (None, [1.0, 1.0]), (50, [1.0]), (8, [0.0, 0.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in
           topk_search.top_k(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 0), (50, 3, 1)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_cascade_is_exact_and_sharded(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 17 == 3).alias("listed"))
    rows = keys.select(F.col("key").alias("host")).union(spark.createDataFrame([(None,)], "host string"))
    for bits in (url_filter.MAX_BITS, 400):
        got = url_filter.with_listed(rows, F.col("host"), keys, max_bits=bits)
        listed = {r.host for r in got.where(got["listed"]).collect()}
        assert listed == {f"h{i}" for i in range(3000) if i % 17 == 3} and got.count() == 3001
    none = url_filter.with_listed(rows, F.col("host"), keys.where("key is null"))
    assert none.where("listed").count() == 0


def test_urls_edges(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?q", "https://example.org/en/17", "x://b.com/de/1#f",
            "x://b.com/fr/1", "http://org", "http://b.com/it/://"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_pages(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert got[5] == ("b.com", "/de/1", "com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7] == ("org", "", None, "allow") and got[8] == ("b.com", "/it/://", None, "allow")


def test_quality_edges(spark):
    poor = [(i, "bad", "# " * 60 if i % 10 else "fine word and more of it here now " * 1 + " ".join(
        f"t{i}x{k}" for k in range(60)), "x") for i in range(100)]
    good = [(200 + i, "good", " ".join(f"g{i}x{k}" for k in range(80)), "x") for i in range(100)]
    edge = [(500, None, None, "x"), (501, "good", "", "x"), (502, "good", "a b c " * 30000, "x")]
    df = spark.createDataFrame(poor + good + edge, "doc_id long, source string, text string, kept string")
    rows = {r.doc_id: r for r in quality_rules.rate_documents(df, drop_text=True).collect()}
    assert all(rows[200 + i].kept for i in range(100)) and all(rows[i].kept for i in range(0, 100, 10))
    assert not any(rows[i].kept for i in range(100) if i % 10)
    assert rows[500].n_words == 0 and rows[500].base_failed and rows[502].n_repeat_words == 90000
    assert quality_rules.rate_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF001)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({catalog.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


def test_pipeline_against_its_stages_by_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    kept = {r.doc_id for r in catalog.QUERIES["op6_quality_rules"](spark, SF001).where("kept").collect()}
    cut = brute_lines([(i, docs[i].text) for i in kept])
    texts = {}
    for i in kept:
        lines = [x for k, x in enumerate(docs[i].text.split("\n")) if k not in cut[i]]
        if not cut[i] or "".join(lines).strip():
            texts[i] = "\n".join(lines)
    joined = brute_join(list(texts.items()))
    left = {i for i in texts if joined[i][2] == i}
    field = pii.trained()
    rows = corpus_pipeline.run(spark, SF001).collect()
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    from wordloom.llm.packing import Tokenizer
    import public_tokenizers as P
    tok = Tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = {i: len(tok.ids(pii.mask(texts[i], pii.find(field, [texts[i]])[0][1]))) + 1 for i in left}
    assert dict(got) == want


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    words = [" ".join(f"d{d}w{k}" for k in range(60)) for d in range(6)]
    rows = [(d, t + "\n" + ("one line that all of them share" if d % 2 else f"line {d}"), "src0", 9, d, -d, "x", "y", "z", "k")
            for d, t in enumerate(words)] + [(9, None, "src1", 0, 9, -9, "x", "y", "z", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, `a.b` int, _cut int, "
                                       "_text string, held string, row string, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted(r["a.b"] for r in docs.collect()) == list(range(6)), name
        assert all(r["_cut"] == -r["a.b"] and r["_text"] == "x" and r["held"] == "y" and r["kept"] == "k" for r in docs.collect())


def test_a_stage_leaves_the_tables_of_other_queries(spark):
    other = catalog.QUERIES["op6_quality_rules"](spark, SF001)
    n = other.count()
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    corpus_pipeline.quality(spark, docs, SF001)
    corpus_pipeline.lines(spark, docs, SF001)
    assert other.count() == n


def test_texts_under_one_id_are_compared_by_their_own_source(spark):
    base = [" ".join(f"b{g}x{k}" for k in range(50)) for g in range(40)]
    rows = [(None, t) for t in base] + [(None, t + " more") for t in base] + [(7, t + " other end") for t in base]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(4)
    out = jaccard_join.join_documents(df).collect()
    assert len(out) == 240 and all(r.n_links == 2 and r.n_copies == 2 for r in out)
