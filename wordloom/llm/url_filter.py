"""Operator 5: exact URL lists as a cascade of Bloom filters.

The key universe is known in full (every key of the corpus), so a cascade of
Bloom filters answers membership exactly: level 1 encodes the listed keys,
level 2 the unlisted keys that level 1 lets through, level 3 the listed keys
that level 2 lets through, and so on until a level lets nothing wrong through.
A row is judged by looking its key up in the levels' bitmaps, which are scalar
values of the plan: there is no join and no Python.

A cascade needs about 1.5 * log2(unlisted / listed) bits a listed key.  Where
one level would pass ``MAX_BITS``, the keys are cut into shards by their hash
and each shard has a cascade of its own, so no bitmap outgrows the bound.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is on no list (verdict ``allow``); repeated rows are
judged alike; with no listed key there is no level and nothing is listed; an
empty table gives an empty table; extra columns are not touched.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stash

#: bits of one level's bitmap at most (8 MB)
MAX_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased."""
    host = F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    path = F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise(F.lit(""))


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    """A rule ``host/path`` fits its host and all subdomains below its path."""
    name, slash, rest = rule.partition("/")
    return (((host == name) | host.endswith("." + name))
            & path.startswith(slash + rest))


def longest_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null where none fits)."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        fits = rule_fits(r, host, path)
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return rule, verdict


def _place(key: Column, level: int, hash_no: int, bits: int) -> Column:
    # the key is hashed last: keys that collide on one level part on the next
    return F.pmod(F.xxhash64(F.lit(level), F.lit(hash_no), key), F.lit(bits))


class Level:
    """One Bloom filter: its bitmap is a one-row table of 64-bit words."""

    def __init__(self, keys: DataFrame, n_keys: int, rate: float, level: int):
        need = math.log2(1 / rate)
        self.level, self.hashes = level, max(1, round(need))
        self.bits = max(64, math.ceil(n_keys * need / math.log(2)))
        spark, n_words = keys.sparkSession, self.bits // 64 + 1
        places = keys.select(F.explode(F.array(
            *[_place(F.col("key"), level, i, self.bits) for i in range(self.hashes)])).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("id")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        dense = (spark.range(n_words).join(words, "id", "left")
                 .select("id", F.coalesce("bits", F.lit(0)).alias("bits")))
        row = dense.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("w"))
        self.table = stash(row.select(F.col("w.bits").alias("words")), "bloom")

    def has(self, key: Column) -> Column:
        """Whether the filter lets a key through."""
        words = self.table.select("words").scalar()
        hit = None
        for i in range(self.hashes):
            p = _place(key, self.level, i, self.bits)
            bit = F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")),
                                  p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
            hit = bit if hit is None else hit & bit
        return hit


class Cascade:
    """Levels that together answer membership exactly over the universe."""

    def __init__(self, universe: DataFrame):
        """``universe``: distinct ``key`` string and ``listed`` boolean."""
        inside = universe.where("listed").select("key")
        outside = universe.where("not listed").select("key")
        n_in, n_out = inside.count(), outside.count()
        self.levels: list[Level] = []
        while n_in:
            first = not self.levels
            rate = min(0.5, max(1e-9, n_in * math.sqrt(0.5) / max(n_out, 1))) if first else 0.5
            level = Level(inside, n_in, rate, len(self.levels) + 1)
            self.levels.append(level)
            if not n_out:
                break
            passed = stash(outside.where(level.has(F.col("key"))), "bloom-passed")
            inside, outside, n_in, n_out = passed, inside, passed.count(), n_in

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.has(key), out).otherwise(F.lit(level.level % 2 == 0))
        return out


def with_listed(df: DataFrame, key: Column, universe: DataFrame, out_col: str = "listed",
                max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with a boolean column: is the row's key listed?

    ``universe`` holds every key that ``df`` can ask for, once, with
    ``listed``.  One cascade, or one for each shard of keys where a level
    would pass ``max_bits``; the shards' rows are judged in separate scans.
    """
    universe = stash(universe.select("key", "listed"), "universe")
    n_listed, n = universe.where("listed").count(), universe.count()
    need = n_listed * 1.45 * max(1.0, math.log2(max(n, 2) / max(n_listed, 1)) + 0.5)
    shards = max(1, math.ceil(need / max_bits))
    parts = []
    for s in range(shards):
        def mine(k):
            return F.pmod(F.xxhash64(k, F.lit("shard")), F.lit(shards)) == s
        whole = shards == 1
        cascade = Cascade(universe if whole else universe.where(mine(F.col("key"))))
        rows = df if whole else df.where(F.coalesce(mine(key), F.lit(s == 0)))
        parts.append(rows.withColumn(out_col, F.coalesce(cascade.listed(key), F.lit(False))))
    return reduce(DataFrame.unionByName, parts)


#: the rules that are judged before the list
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]] = RULES,
                max_bits: int = MAX_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every page.

    The longest fitting rule decides.  Else the list does: it holds the hosts
    with more pages blocked by a rule than allowed by one.
    """
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = longest_rule(rules, F.col("host"), F.col("path"))
    base = base.withColumns({"rule": rule, "ruled": ruled})
    universe = (base.where("host <> ''").groupBy(F.col("host").alias("key"))
                .agg((F.count_if(F.col("ruled") == "block") > F.count_if(F.col("ruled") == "allow"))
                     .alias("listed")))
    judged = with_listed(base, F.col("host"), universe, max_bits=max_bits)
    judged = judged.withColumn("listed", F.col("listed") & (F.col("host") != ""))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


ORACLE = r"""
with cut as (
  select page_id,
         case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
parts as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut),
ruled as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/'
  end as rule from parts),
voiced as (
  select *, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block'
                 when rule is not null then 'allow' end as said from ruled),
lists as (
  select host, count(*) filter (said = 'block') > count(*) filter (said = 'allow') as listed
  from voiced where host <> '' group by host)
select page_id, voiced.host as host, path, rule,
       coalesce(said, case when listed then 'block' else 'allow' end) as verdict,
       coalesce(listed, false) as listed
from voiced left join lists on voiced.host = lists.host
"""
