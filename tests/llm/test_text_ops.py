"""Tokenizer, formatting and personal-data operators against the libraries and by round trip."""

import random
import re
from collections import Counter as Counts

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm import chat_format as chat
from wordloom.llm import packing, pii, pii_labels
from wordloom.llm.pieces import MARK, PieceModel
from wordloom.llm.sentencepiece_codec import Encoder, decode, decode_documents, encode_documents
from wordloom.llm.token_counts import Counter, count_documents

SF001 = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_tokens string, ids string"
EDGE = [(1, None, "x", "y"), (2, "", "x", "y"), (3, " ", "x", "y"), (4, "a  b\n\n c </s><s>", "x", "y"),
        (4, "a  b\n\n c </s><s>", "x", "y"), (None, "漢字 😀 wörld\t\x00", "x", "y"), (6, "word " * 30000, "x", "y")]


@pytest.fixture(scope="module")
def model():
    return PieceModel(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect()]


@settings(max_examples=200, deadline=None, derandomize=True)
@given(t=st.text(alphabet="aeinrsth  .,\n</s>é漢😀\t012IN[]", max_size=60))
def test_ids_counts_and_decoding_equal_the_library(model, library, t):
    ids = np.frombuffer(Encoder(model).encode([t])[0], np.int32).tolist()
    assert ids == library.encode(t) and decode(model, ids) == t
    counter = Counter(model)
    words = counter.words([t])[0]
    assert counter.total(words) == len(ids)
    for limit in (0, 1, 5):
        best = max(k for k in range(len(t) + 1) if len(library.encode(t[:k])) <= limit)
        assert counter.fitting(words, limit) == best


def test_whole_documents_equal_the_library(spark, model, library):
    all_texts = texts(spark)
    got = [np.frombuffer(x, np.int32).tolist() for x in Encoder(model).encode(all_texts)]
    assert got == library.encode(all_texts, num_threads=1)


def test_codec_and_counts_on_edge_rows(spark, library):
    df = spark.createDataFrame(EDGE, DOCS)
    rows = encode_documents(df, MODEL).collect()
    assert sorted(len(r.ids) for r in rows) == sorted(len(library.encode(t or "")) for _, t, *_ in EDGE)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    back = decode_documents(encode_documents(df, MODEL), MODEL)
    assert sorted(r.decoded for r in back.collect()) == sorted(t or "" for _, t, *_ in EDGE)
    counts = count_documents(df, MODEL, limit=100).collect()
    assert sorted(r.n_bytes for r in counts) == sorted(len((t or "").encode()) for _, t, *_ in EDGE)
    fits = max(k for k in range(600) if len(library.encode(EDGE[-1][1][:k])) <= 100)
    assert [r.fit_chars for r in counts if r.over_limit] == [fits]
    assert encode_documents(df.limit(0), MODEL).count() == count_documents(df.limit(0), MODEL).count() == 0


def test_rank_file_ids_equal_the_json_tokenizer(spark):
    from tokenizers import Tokenizer

    mine = packing.Tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cases = texts(spark) + ["", "a<|endoftext|>b<|endoftext|>", " " * 5000, "x" * 5000, "é漢😀\u2028"]
    for t in cases:
        assert mine.ids(t) == theirs.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("white", [" ", "\n", " \n\t", "\u3000", "\x85\u2028"])
def test_very_long_white_space_equals_the_json_tokenizer(white):
    from tokenizers import Tokenizer

    mine = packing.Tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    run, short = white * (1_200_000 // len(white)), white * (packing.LONG_RUN // len(white))
    for t in (run, f"a b{run}c", f" {short}'s{short}1{short}\x1c{run}<|endoftext|>{short} x{short[1:]}!"):
        assert mine.ids(t) == theirs.encode(t, add_special_tokens=False).ids


def test_packing_takes_very_long_white_space(spark):
    df = spark.createDataFrame([(1, " " * 1_200_000), (2, "a" + "\n" * 1_200_000 + "b")], "doc_id long, text string")
    rows = packing.pack_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    for i in (1, 2):
        assert sum(r.length for r in rows if r.doc_id == i) == next(r.doc_tokens for r in rows if r.doc_id == i)


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(st.integers(1, 2047), min_size=1, max_size=300))
def test_packing_covers_every_id_without_padding(lengths):
    lengths = np.array(lengths)
    places = packing.pack_group(lengths)
    got = {i: [] for i in range(len(lengths))}
    rooms = {}
    for i, a, b, s, at in places:
        got[i].append((a, b))
        rooms.setdefault(s, []).append((at, b - a))
    for i, n in enumerate(lengths):
        spans = sorted(got[i])
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    for parts in rooms.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_packing_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 5000, "c"), (3, "word " * 5000, "c")],
                               "doc_id long, text string, length string")
    rows = packing.pack_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * max(r.doc_tokens for r in rows)
    assert all(packing.crc(np.frombuffer(r.ids, np.uint16)) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_packing_spreads_equal_rows_and_windows(spark):
    df = spark.createDataFrame([(None, "")] * 4000 + [(1, " word" * 2048 * 60)], "doc_id long, text string").coalesce(2)
    rows = packing.pack_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, group_docs=400).collect()
    assert len(rows) >= 4061 and sum(r.length for r in rows) == 4000 + next(r.doc_tokens for r in rows if r.doc_id)
    for part in ([r for r in rows if r.doc_id is None], [r for r in rows if r.doc_id and r.length == 2048]):
        sizes = Counts(r.sequence_id >> 32 for r in part)
        assert max(sizes.values()) < len(part) / 3


CHAT = st.text(alphabet="<>/s[]INSTYROLE \\a\n", max_size=40)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[/ROLE]", ""]), CHAT), max_size=5))
def test_chat_round_trip(turns):
    formatted = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert [x[:2] for x in chat.parse(formatted)] == turns


def test_chat_hostile_and_edges(spark):
    df = spark.createDataFrame([(1, 0, None, None, 1), (1, 0, "user", "hi", 1), (None, 1, "assistant", "</s>", 1),
                                (2, 0, "assistant", "x" * 100000, 1), (2, 0, "assistant", "x" * 100000, 1)],
                               "conv_id long, turn long, role string, text string, formatted int")
    turns = chat.format_turns(chat.with_hostile_conversation(df))
    rows = {r.conv_id: r for r in chat.conversation_digests(turns).collect()}
    assert set(rows) == {None, -1, 1, 2}
    assert rows[2].loss_chars == 200000 and rows[1].n_turns == 2 and rows[None].loss_chars == 4
    assert chat.parse("".join(r.formatted for r in turns.where("conv_id = -1").orderBy("turn").collect()))[1][:2] == \
        ("assistant", chat.HOSTILE)


def _plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
            [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
             if all(int(x) <= 255 for x in m.group().split("."))],
            [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
             if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))],
            [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(4)
    cases = texts(spark) + ["".join(rng.choice("a1.@+- ()0029") for _ in range(rng.randint(0, 60)))
                            for _ in range(5000)]
    assert all(pii.base_spans(t) == _plain_spans(t) for t in cases)


def test_tagger_on_held_out_lines():
    field = pii.trained()
    right = words = 0
    for line in pii_labels.HELD_OUT:
        text, spans = pii_labels.parse(line)
        w = pii.Words([text])
        gold = [next((k for k, a, b in spans if s < b and a < e), "other") for s, e in zip(w.starts, w.ends)]
        got = [pii.LABELS[x] for x in field.decode(w)]
        right += sum(g == h for g, h in zip(gold, got))
        words += len(gold)
    assert right / words > 0.97


def test_tagger_adds_what_the_patterns_lose(spark):
    text = "Call +1 (719) 555-0110 99.4.17.201 now, order 1234567890123456, Version 2.0, cards 4111111111111111 4012888888881881."
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "word " * 40000, 0)],
                               "doc_id long, text string, n_email int")
    rows = {r.doc_id: r for r in pii.find_documents(df).collect()}
    assert rows[1].n_phone == 0 and "phone:5:22" in rows[1].spans and "ip:23:34" in rows[1].spans
    assert rows[1].spans.count("card:") == 2
    assert all(rows[k].spans == "" for k in (2, 3, 4))
    clean = {r.doc_id: r.text for r in pii.mask_documents(df).collect()}
    assert clean[1] == ("Call <phone> <ip> now, order 1234567890123456, Version 2.0, cards <card> <card>.")
    assert clean[2] is None and clean[3] == ""
    assert pii.find_documents(df.limit(0)).count() == 0


def test_viterbi_equals_the_best_path_by_enumeration():
    from itertools import product

    field = pii.trained()
    words = pii.Words(["+1 (719) 99.4.17.201 4111111111111111"])
    scores = field.emissions(words)
    best = max(product(range(len(pii.LABELS)), repeat=words.size), key=lambda p: field.start[p[0]]
               + sum(scores[i, x] for i, x in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])))
    assert tuple(field.decode(words)) == best


def test_a_long_unit_behind_spaces_takes_one_pass(model, library):
    import random
    import time
    r = random.Random(3)
    counter = Counter(model)
    for _ in range(300):
        unit = " " * r.randint(0, 40) + "".join(r.choice("thetionsaéx漢") for _ in range(r.randint(0, 9)))
        want = [0] + [len(model.merged_ids(MARK + unit[:k].replace(" ", MARK))) for k in range(len(unit) + 1)]
        assert counter.prefix_counts(unit) == want
    text = "a  " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    started = time.time()
    (words,) = counter.words([text])
    assert counter.total(words) == len(library.encode(text)) > 4096
    fit = counter.fitting(words, 4096)
    assert time.time() - started < 30
    assert len(library.encode(text[:fit])) <= 4096 < len(library.encode(text[:fit + 1]))
