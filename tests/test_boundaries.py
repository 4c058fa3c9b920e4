"""Words by the Unicode boundary rules against a plain interpreter of the rules."""

import random
import unicodedata

import duckdb

from wordloom.functions import text as T
from wordloom.functions.text import NOT_A_WORD, boundary_tokens
from wordloom.plans.catalog import sql_boundary_pattern


def kind(c):
    def inside(table):
        return any(a <= ord(c) <= b for a, b in table)
    cat = unicodedata.category(c)
    if c in T.MID_BOTH:
        return "MB"
    if c in T.MID_LETTER:
        return "ML"
    if c in T.MID_NUMBER:
        return "MN"
    if inside(T.KATAKANA):
        return "K"
    if cat in ("Mn", "Mc", "Me", "Cf") and ord(c) != T.ZERO_WIDTH_SPACE:
        return "X"
    if cat == "Pc" or c == " ":
        return "E"
    if cat == "Nd":
        return "N"
    if cat in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl"):
        return "U" if inside(T.UNSPACED) else "A"
    return "O"


def plain_words(text):
    """Rules 4 to 13b, decided for every place between two characters."""
    text = text.lower()
    kinds = [kind(c) for c in text]
    base = [i for i, k in enumerate(kinds) if k != "X" or i == 0]  # rule 4: marks belong to what they follow
    words, current = [], ""
    for p, i in enumerate(base):
        end = base[p + 1] if p + 1 < len(base) else len(text)
        joined = False
        if p:
            a, b = kinds[base[p - 1]], kinds[i]
            before = kinds[base[p - 2]] if p > 1 else ""
            after = kinds[base[p + 1]] if p + 1 < len(base) else ""
            joined = ((a in "AN" and b in "AN")                                              # 5, 8, 9, 10
                      or (a == "A" and b in ("ML", "MB") and after == "A")                   # 6
                      or (before == "A" and a in ("ML", "MB") and b == "A")                  # 7
                      or (before == "N" and a in ("MN", "MB") and b == "N")                  # 11
                      or (a == "N" and b in ("MN", "MB") and after == "N")                   # 12
                      or (a == "K" and b == "K")                                             # 13
                      or (a in "ANKE" and b == "E") or (a == "E" and b in "ANK"))            # 13a, 13b
        if joined:
            current += text[i:end]
        else:
            words.append(current)
            current = text[i:end]
    return [w for w in words + [current] if any(kind(c) in "ANKU" for c in w)]


ALPHABET = list("abcxyz019__..,,::;''- \n") + list("éßאبи漢字ひカーナไทย́̈­‍​’·٣५‿①ⅷ😀️")


def texts():
    r = random.Random(11)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    out += ["3.14 1,000.5 it's a.b e.g. x:y 10:30 3.a a.3 foo_bar __ _a_ a__", "don’t ét́e ́a",
            "カタカナ漢字ひらがなabc", "a'", "'a'b'", "1.2.3,4", "", "mail@example.org http://a.b/c?d=1_2"]
    # any assigned character in a context of letters and digits
    pool = [c for c in map(chr, range(0x250, 0x11000)) if unicodedata.category(c)[0] in "LMNP"
            and unicodedata.ucd_3_2_0.category(c) != "Cn"]  # those every engine knows
    out += [f"a{c}b {r.choice('1a')}{c}{r.choice('2カ')}" for c in r.sample(pool, 1500) if len(c.lower()) == 1]
    return out


def test_words_equal_the_rules(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    got = {r.i: r.w for r in df.select("i", boundary_tokens("t").alias("w")).collect()}
    bad = [(t, got[i], plain_words(t)) for i, t in rows if got[i] != plain_words(t)]
    assert not bad, (len(bad), bad[:5])


def test_sql_pattern_equals_the_rules():
    con = duckdb.connect()
    rows = texts()
    con.execute("CREATE TABLE t (i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(rows[-1800:])))
    got = con.execute(f"SELECT t, list_filter(regexp_extract_all(lower(t), '{sql_boundary_pattern()}'), "
                      f"lambda w: NOT regexp_matches(w, '{NOT_A_WORD}')) FROM t").fetchall()
    bad = [(t, w, plain_words(t)) for t, w in got if w != plain_words(t)]
    assert not bad, (len(bad), bad[:5])


def test_very_long_words_take_no_stack(spark):
    long = ["a1" * 200_000, "_" * 300_000, "a." * 200_000 + "a", "1," * 200_000 + "2", "a_" * 200_000, "é" * 200_000]
    df = spark.createDataFrame(list(enumerate(long)), "i int, t string")
    got = {r.i: r.w for r in df.select("i", boundary_tokens("t").alias("w")).collect()}
    assert [got[i] for i in range(6)] == [[long[0]], [], [long[2]], [long[3]], [long[4]], [long[5]]]
