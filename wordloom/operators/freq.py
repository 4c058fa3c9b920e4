"""Counting, shares, top-k and display order.

Design notes (scale):
* counts are ``groupBy`` aggregates: partial (map-side) counts run in the same
  stage as tokenising, so only distinct keys per task are shuffled;
* group totals are a separate aggregate joined back (the planner broadcasts
  the small totals from their measured size), not a window over the whole
  group: a hot group never lands in one task;
* top-k uses ``rank``/``row_number`` filters that Spark turns into a
  per-partition group limit before the shuffle (``WindowGroupLimit``), so
  only k rows (plus ties) per group and task move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_by(df: DataFrame, *keys: str, name: str = "n", sort: bool = False) -> DataFrame:
    """Rows per key as ``n`` (nulls form their own group).  ``sort`` orders by
    ``n`` descending, then keys ascending."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    if sort:
        out = out.orderBy(F.desc(name), *[F.asc_nulls_first(k) for k in keys])
    return out


def held(key: str, n: str = "n") -> Column:
    """The key of a count table, for readers that share its shuffle.

    Its value is the key's (a count is never 0), but as it depends on the
    count, filters on it stay above the aggregate.  On the plain key the
    optimizer would move each reader's filters below the shuffle, and readers
    with different filters would each compute the counts anew."""
    return F.when(F.col(n) > 0, F.col(key)).alias(key)


def group_totals(df: DataFrame, group: list[str], value: str = "n", name: str = "total") -> DataFrame:
    return df.groupBy(*group).agg(F.sum(value).alias(name))


def with_totals(df: DataFrame, group: list[str], value: str = "n", name: str = "total") -> DataFrame:
    """Attach the group total of ``value`` to every row (null-safe on keys)."""
    tot = group_totals(df, group, value, name)
    cond = [df[g].eqNullSafe(tot[g]) for g in group]
    return df.join(tot, cond, "left").select(df["*"], tot[name])


def share_within(df: DataFrame, group: list[str], value: str = "n", name: str = "proportion",
                 keep_total: bool = False) -> DataFrame:
    """``value / sum(value)`` within each group."""
    out = with_totals(df, group, value, "_total").withColumn(
        name, F.try_divide(F.col(value).cast("double"), F.col("_total").cast("double")))
    return out if keep_total else out.drop("_total")


def top_n(df: DataFrame, k: int, weight=None, group: list[str] | None = None,
          ties: bool = True) -> DataFrame:
    """Rows with the ``k`` largest weights (per group when ``group`` is given).

    ``weight`` defaults to the last column.  Without ``group`` the rank filter
    still runs as a per-partition limit first, so only k rows (plus ties) per
    task reach the single final partition.

    ``ties=True`` keeps every row tied with the k-th (rank); ``False`` cuts at
    exactly ``k`` rows, breaking ties by the remaining columns ascending.
    Rows with a null weight are never selected.
    """
    w = _col(weight if weight is not None else df.columns[-1])
    cols = df.columns
    df = df.where(w.isNotNull())
    order = [w.desc()]
    if ties:
        fn = F.rank()
    else:
        order += [F.asc_nulls_first(c) for c in cols if c not in (group or [])]
        fn = F.row_number()
    spec = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    return df.withColumn("_rk", fn.over(spec)).where(F.col("_rk") <= k).drop("_rk")


def order_column(df: DataFrame, by, label: str, group: list[str] | None = None,
                 name: str = "ord", descending: bool = False, dense: bool = False) -> DataFrame:
    """Display order of a category by a statistic: 1, 2, ... within ``group``.

    ``dense`` gives rows of the same category the same position (a category
    that appears on several rows, e.g. a word with two emotions).  Meant for
    already-reduced results (after a top-k), where a group is small.
    """
    b = _col(by)
    order = [b.desc() if descending else b.asc(), F.col(label).asc()]
    spec = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    return df.withColumn(name, (F.dense_rank() if dense else F.row_number()).over(spec))


def order_column_wide(df: DataFrame, by: str, label: str, group: list[str],
                      name: str = "ord") -> DataFrame:
    """``order_column`` for groups that are not small: the rows of a group are
    numbered inside each value of ``by``, and start behind the rows with
    smaller values.  The starts come from a histogram of ``by``, so no task
    orders a whole group.  Null values of ``by`` come first."""
    hist = df.groupBy(*group, by).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, by]
    hist = hist.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                       F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(label))
    return df.withColumn("_in", inside).join(hist, same).select(
        *df.columns, (F.col("_start") + F.col("_in")).cast("int").alias(name))


def order_by_stat(df: DataFrame, by: str, label: str, stat: str = "mean", digits: int = 9,
                  group: list[str] | None = None, name: str = "ord") -> DataFrame:
    """Display order of a label that occurs on several rows: every row of a
    label gets the label's position by the ``mean`` or ``median`` of ``by`` over
    its rows (rounded, ties by label).  Meant for already-reduced results."""
    group = list(group or [])
    value = {"mean": F.avg, "median": F.median}[stat](by)
    pos = df.groupBy(*group, label).agg(F.round(value, digits).alias("_stat"))
    pos = order_column(pos, "_stat", label, group, name)
    keys = [*group, label]
    pos = pos.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(pos, same).select(*df.columns, name)


def histogram(df: DataFrame, value, group: list[str], hi: float, bins: int = 30,
              lo: float = 0.0) -> DataFrame:
    """Counts of ``value`` in ``bins`` equal bins on ``[lo, hi]`` per group;
    values above ``hi`` are removed first (an axis limit)."""
    v = _col(value)
    width = (hi - lo) / bins
    b = F.least(F.floor((v - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)), F.lit(bins - 1)).cast("int")
    return (df.where(v <= hi).select(*group, b.alias("bin"))
            .groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_lo", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 12)))


def keep_frequent(df: DataFrame, key: str, min_n: int, weight: str | None = None) -> DataFrame:
    """Keep every row whose ``key`` occurs at least ``min_n`` times; ``weight``
    names the column that counts for each row (rows count once without it).

    A count aggregate plus a semi join (not a window over the key, which would
    put all rows of a hot key in one task)."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    hot = df.groupBy(key).agg(n.alias("_n")).where(F.col("_n") >= min_n)
    return df.join(hot, df[key].eqNullSafe(hot[key]), "left_semi")


#: cells of a count gate: its bitmap has a fixed size of CELLS / 8 bytes
CELLS = 1 << 22


def cell_gate(keys: DataFrame, key: Column, least: int, cells: int = CELLS) -> Column:
    """A condition on ``key`` that holds for every key with ``least`` rows or more
    in ``keys``, and for few others.

    Rows are counted in a fixed number of hash cells; a key cannot be more
    frequent than its cell.  The cells that reach ``least`` travel as a bitmap,
    one scalar of fixed size, so rare keys stop in the stage that makes them
    and are never shuffled.  Callers count the keys that pass exactly.
    """
    return cell_gates(keys, [key], least, cells)


def cell_gates(rows: DataFrame, keys: list[Column], least: int, cells: int = CELLS) -> Column:
    """The condition that every one of ``keys`` passes a ``cell_gate`` of its own;
    all gates are counted in one pass over ``rows`` and share a bitmap."""
    own = [F.pmod(F.xxhash64(key), F.lit(cells)) + i * cells for i, key in enumerate(keys)]
    cell = own[0] if len(own) == 1 else F.explode(F.array(*own))
    full = (rows.select(cell.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
            .groupBy(F.shiftright("cell", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")))
    words = rows.sparkSession.range(len(own) * cells // 64 + 1).withColumnRenamed("id", "word").join(full, "word", "left")
    row = words.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w"))
    bits = row.select(F.col("w.bits").alias("w")).scalar()

    def passes(c):
        word = F.get(bits, F.shiftright(c, 6).cast("int"))
        return F.call_function("shiftright", word, c.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return reduce(Column.__and__, map(passes, own))


def count_frequent(df: DataFrame, *keys: str, least: int, name: str = "n", cells: int = CELLS) -> DataFrame:
    """``count_by`` of the keys with ``least`` rows or more; rows of other keys
    are dropped before the shuffle, as far as the gate knows them."""
    gate = cell_gate(df, F.struct(*[F.col(k) for k in keys]), least, cells)
    return count_by(df.where(gate), *keys, name=name).where(F.col(name) >= least)


def frequent_ngrams(grams: DataFrame, group: list[str], words: list[str], least: int,
                    cells: int = CELLS) -> DataFrame:
    """Counts of the n-grams (columns ``words``) with ``least`` occurrences or more
    per group, by Apriori pruning: an n-gram goes on only if all its bigrams
    may be as frequent.

    Each position of the n-gram has a gate of its own: the pair at position i
    of an n-gram with ``least`` rows has that many rows at position i as well.
    All gates are counted in one pass over the texts, and a second one counts
    what passes them.
    """
    pairs = [F.struct(*[F.col(c) for c in (*group, a, b)]) for a, b in zip(words, words[1:])]
    if not pairs:
        return count_frequent(grams, *group, *words, least=least, cells=cells)
    passed = grams.where(cell_gates(grams, pairs, least, cells))
    return count_by(passed, *group, *words).where(F.col("n") >= least)
