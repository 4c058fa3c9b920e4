"""Operator 13: spelling variant grouping by asymmetric q-chunks.

Words one edit apart (one character inserted, deleted or replaced) are found
by an equi-join: of two such words the shorter one (either, if equally long)
contributes two disjoint chunks, its halves, and the other one its positional
grams of the same sizes.  The edit lies in one half at most, so the other half
appears as a gram, in place or shifted by one; longer shifts cannot occur and
are not emitted.  A plain half as key meets thousands of words ("-tion"), so
the half with the edit is cut into two chunks again, one of which the edit
spares: every key names a half and a quarter, four keys a word.  Pairs are
verified by their edit distance.

A word's form is its near word with the largest count, if that is ``ratio``
times its own or more; following forms to the last gives its root.  As counts
grow by the factor ``ratio`` in each step, the number of rounds of pointer
doubling is known from the largest count.

Words are counted where texts are read (bounded memory, summed per task);
everything else is Spark joins and aggregates.  Defined results: maximal runs
of ``[A-Za-z]`` and U+00C0-U+00FF, only A-Z lower-cased; a null or empty text
has none; a null doc_id is written as an empty string in the thinning key; ids
may repeat; very long texts count whole; an empty table gives an empty table;
other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stash

#: distinct words a task counts before it sends them on
HELD = 400_000

# one byte a code point up to U+00FF, a question mark for all others
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """The lower-cased runs of a text, in Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_TABLE).split()


def thinned(run: bytes, doc_key: int, thin: int) -> bytes:
    """The run, one code point less where ``thin`` divides the checksum of
    ``<doc_id>:<run>``; ``doc_key`` is the checksum of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc_key)
    if h % thin:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(df: DataFrame, least_size: int = 6, least_n: int = 5, thin: int = 199,
                text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``word, n`` of the words with enough characters and occurrences."""
    source = df.select(df[f"`{id_col}`"].cast("string").alias("id"), df[f"`{text_col}`"].cast("string").alias("text"))

    def count(batches):
        held: Counter[bytes] = Counter()

        def out():
            words = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in words], pa.string()),
                 pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, c in Counter(runs(text.as_py())).items():
                    # deleting never makes a word longer
                    if len(run) >= least_size:
                        word = thinned(run, key, thin)
                        if len(word) >= least_size:
                            held[word] += c
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return (source.mapInArrow(count, "word string, n bigint").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= least_n))


def _keys(size: Column, shift: int) -> Column:
    """Keys of ``word`` beside words of ``size`` characters: chunks (``shift`` 0,
    its own size) or the grams of a word that is ``shift`` longer."""
    half = F.floor(size / 2).cast("int")
    first, second = F.floor(half / 2).cast("int"), half + F.floor((size - half) / 2).cast("int")
    length = size + F.lit(shift)

    def part(a, b):
        return F.substring("word", a + 1, b - a)

    zero = F.lit(0)
    kept = [  # the edit lies in the last, third, second or first quarter
        (part(zero, half), part(half, second)),
        (part(zero, half), part(second + shift, length)),
        (part(half + shift, length), part(zero, first)),
        (part(half + shift, length), part(first + shift, half + shift))]
    return F.array(*[F.xxhash64(size, F.lit(i), a, b) for i, (a, b) in enumerate(kept)])


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: both directions of every pair that is one edit
    apart, once.  ``words`` holds ``word`` (distinct, two characters or more) and ``n``."""
    sized = words.select("word", "n", F.char_length("word").alias("size"))
    chunks = sized.select("word", "n", "size", F.explode(_keys(F.col("size"), 0)).alias("key"))
    grams = sized.select("word", "n", "size", F.explode(F.concat(
        _keys(F.col("size"), 0), _keys(F.col("size") - 1, 1))).alias("key"))
    x, y = chunks.alias("x"), grams.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key"))
                   & ((F.col("x.size") < F.col("y.size")) | (F.col("x.word") < F.col("y.word")))
                   & (F.levenshtein("x.word", "y.word", 1) == 1))
    pairs = pairs.select(F.col("x.word").alias("word"), F.col("x.n").alias("n"),
                         F.col("y.word").alias("near"), F.col("y.n").alias("near_n")).distinct()
    turned = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                          F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.union(turned)


def roots(links: DataFrame, rounds: int) -> DataFrame:
    """``word, root`` of words with a ``form``: the end of their chain, by
    doubling steps."""
    for _ in range(rounds):
        far = links.select(F.col("word").alias("form"), F.col("form").alias("far"))
        links = stash(links.join(far, "form", "left")
                      .select("word", F.coalesce("far", "form").alias("form")), "spell-links")
    return links.withColumnRenamed("form", "root")


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    words = stash(words, "spell-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = stash(near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), best.alias("best")), "spell-near")
    formed = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.near"))
    near = near.select("word", "n_near", formed.alias("form"),
                       F.when(formed.isNotNull(), -F.col("best.m")).alias("form_n"))
    most = words.agg(F.max("n")).first()[0] or 1
    # a chain of forms has at most log(most) / log(ratio) links
    rounds = max(1, math.ceil(math.log2(math.log(most) / math.log(ratio) + 1)))
    ends = roots(near.where("form is not null").select("word", "form"), rounds)
    return (words.join(near, "word", "left").join(ends, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n",
                    F.coalesce("root", "word").alias("root")))


ORACLE = r"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(regexp_extract_all(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS c FROM raw WHERE length(run) >= 6 GROUP BY ALL),
-- the table of the checksum, eight steps for each byte
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(
       list_prepend(i, [CAST(0 AS UBIGINT) FOR k IN range(8)]),
       lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
       FROM (SELECT CAST(range AS UBIGINT) AS i FROM range(256)))),
bytes AS (SELECT doc_id, run, c, flatten([CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS UBIGINT)]
       ELSE [CAST(192 + unicode(s) // 64 AS UBIGINT), CAST(128 + unicode(s) % 64 AS UBIGINT)] END
       FOR s IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]) AS b FROM runs),
summed AS (SELECT run, c, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), b),
       lambda a, x: xor(a >> 8, t[CAST(xor(a & 255, x) AS BIGINT) + 1])), 4294967295) AS BIGINT) AS h FROM bytes, crc),
thin AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2)
         ELSE run END AS word, c FROM summed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM thin WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
         UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_max(near, near_n) FILTER (near_n = top AND near = low) AS near, any_value(top) AS top, any_value(n) AS n
         FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top,
                      min(near) OVER (PARTITION BY word, near_n) AS low FROM near) GROUP BY word),
forms AS (SELECT word, near AS form, top AS form_n FROM best WHERE top >= 5 * n),
chain AS (SELECT word, form FROM forms UNION ALL
          SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.form),
ends AS (SELECT word, form AS root FROM chain WHERE form NOT IN (SELECT word FROM forms))
SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, f.form, f.form_n,
       coalesce(e.root, w.word) AS root
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
"""
