"""Operator 6: quality rules with host-level verdicts.

Base rules look at one document.  Host-level rules look at its domain: rule
failures are added up by domain, the failure rates are shrunk towards the
rate of all domains with a beta prior fitted to the domains themselves
(method of moments), and the domain's verdict is joined back.  On a domain in
poor standing a document also has to pass the soft rules; elsewhere a soft
failure alone rejects nothing, so clean documents of any domain stay.

Everything is built-in functions on one pass over the texts.  Words are
``[^\\x20\\x09-\\x0D]+``; 3-word windows are compared inside the row by sorting
them (hash first, then the words).

Defined results: a null or empty text has no words and fails; a null domain
is a domain of its own; repeated rows count each; an empty table gives an
empty table (no domain, no verdict); input columns that share a name with an
output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stash

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: soft rules: symbols a hundred words, duplicate lines a hundred lines
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 30
#: shrunk failure rate above which a domain is in poor standing
POOR_RATE = 0.5


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice."""
    n = F.size(words)
    span = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(words, 1, span).alias("a"),
                           F.slice(words, F.lit(2), span).alias("b"),
                           F.slice(words, F.lit(3), span).alias("c"))
    return F.sort_array(F.transform(windows, lambda w, i: F.struct(
        F.xxhash64(w.a, w.b, w.c).alias("h"), w.a.alias("a"), w.b.alias("b"), w.c.alias("c"),
        i.alias("i"))))


def _covered(ordered: Column) -> Column:
    """Number of words covered by the windows that equal a neighbour."""
    m = F.greatest(F.size(ordered) - 1, F.lit(0))
    twins = F.zip_with(F.slice(ordered, 1, m), F.slice(ordered, F.lit(2), m), lambda p, q: F.when(
        (p.h == q.h) & (p.a == q.a) & (p.b == q.b) & (p.c == q.c), F.array(p.i, q.i)))
    starts = F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull())))
    return F.size(F.array_distinct(F.flatten(F.transform(
        starts, lambda i: F.array(i, i + 1, i + 2)))))


def with_base_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words, base_failed, soft_failed``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns({
        "_words": words, "_lines": lines,
        "word_chars": F.char_length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": _repeat_words(F.col("_words")),
    })
    out = out.withColumn("n_repeat_words", _covered(F.col("_windows")).cast("long"))
    n = F.col("n_words")
    return out.withColumns({
        "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "soft_failed": (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n)
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")),
    }).drop("_words", "_lines", "_windows")


def host_verdicts(rated: DataFrame, domain: str, poor_rate: float = POOR_RATE) -> DataFrame:
    """``domain, n_docs, n_failed, rate, poor`` for every domain (null included).

    Beta(a, b): mean m = failures / documents over everything, and a + b from
    the variance v of the domains' rates, a + b = m (1 - m) / v - 1, at least 1.
    """
    hosts = rated.groupBy(F.col(domain).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"),
                      F.var_pop(raw).alias("v"))
    m = prior.select("m").scalar()
    v = prior.select("v").scalar()
    size = F.greatest(F.coalesce(F.try_divide(m * (1 - m), v) - 1, F.lit(1e9)), F.lit(1.0))
    rate = (F.col("n_failed") + m * size) / (F.col("n_docs") + size)
    return hosts.withColumn("rate", rate).withColumn("poor", F.col("rate") > poor_rate)


def rate_documents(df: DataFrame, domain: str = "source", text_col: str = "text",
                   poor_rate: float = POOR_RATE, drop_text: bool = False) -> DataFrame:
    """``df`` (without its text if ``drop_text``) with the base columns and ``kept``.

    The rated rows are written once, so texts are read and split once; the
    poor domains are a small written table, which Spark broadcasts only while
    its size is below the session's limit.
    """
    rated = with_base_rules(df, text_col)
    rated = stash(rated.drop(text_col) if drop_text else rated, "rated")
    poor = stash(host_verdicts(rated, domain, poor_rate).where("poor").select("domain"), "poor-hosts")
    flag = poor.withColumn("_poor", F.lit(True))
    out = rated.join(flag, rated[domain].eqNullSafe(flag["domain"]), "left")
    kept = ~F.col("base_failed") & ~(F.col("soft_failed") & F.col("_poor").isNotNull())
    return out.select(*[rated[c] for c in rated.columns if c.lower() != "kept"], kept.alias("kept"))


ORACLE = r"""
with base as (
  select doc_id, source, coalesce(text, '') as text from documents),
split_up as (
  select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from base),
numbered as (
  select doc_id, unnest(words) as w, unnest(range(len(words))) as i from split_up),
windows as (
  select doc_id, i, w as a, lead(w) over g as b, lead(w, 2) over g as c
  from numbered window g as (partition by doc_id order by i)),
marked as (
  select doc_id, i, count(*) over (partition by doc_id, a, b, c) as k from windows where c is not null),
covered as (
  select doc_id, count(distinct p) as n from (
    select doc_id, unnest([i, i + 1, i + 2]) as p from marked where k > 1) group by doc_id),
counted as (
  select doc_id, source, len(words)::bigint as n_words,
         length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         len(lines)::bigint as n_lines,
         coalesce(covered.n, 0)::bigint as n_repeat_words
  from split_up left join covered using (doc_id)),
failed as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         100 * n_symbols > 20 * n_words or 100 * n_dup_lines > 30 * n_lines as soft_failed
  from counted),
hosts as (
  select source, count(*) as n_docs, count(*) filter (base_failed or soft_failed) as n_failed
  from failed group by source),
prior as (
  select sum(n_failed) / sum(n_docs) as m, var_pop(n_failed / n_docs) as v from hosts),
sized as (
  select m, greatest(case when v = 0 then 1e9 else m * (1 - m) / v - 1 end, 1.0) as s from prior),
poor as (
  select source from hosts, sized where (n_failed + m * s) / (n_docs + s) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (soft_failed and exists (
         select 1 from poor where poor.source is not distinct from failed.source)) as kept
from failed
"""
