"""Student's t in column expressions (Spark SQL has no such function), and for
single numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


#: steps of the recurrence in front of the series below
SHIFT = 20


def _log_half_step(a, log):
    """``log(gamma(a + 1/2) / gamma(a))``: an asymptotic series behind ``SHIFT``
    steps of the recurrence, so nothing large cancels; ``a`` is a number or a column."""
    z = a + SHIFT
    r = 1 / (z * z)
    series = (-1 / 8 + r * (1 / 192 - r * (1 / 640 - r * (17 / 14336)))) / z
    out = 0.5 * log(z) + series
    for j in range(SHIFT):
        out = out + log((a + j) / (a + (j + 0.5)))
    return out


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function by forward steps.

    The number of steps follows from the parameters (the fraction settles
    within a few times the square root of the larger one)."""
    steps = F.sequence(F.lit(1), (F.lit(30) + 4 * F.sqrt(F.greatest(a, b))).cast("int"))
    tiny = F.lit(1e-300)

    def safe(v):
        return F.when(F.abs(v) > tiny, v).otherwise(tiny)

    def update(state, term):
        d = 1 / safe(1 + term * state["d"])
        c = safe(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def step(state, i):
        m = i.cast("double")
        state = update(state, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return update(state, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def p_value_col(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom: the
    regularised incomplete beta function at ``df / (df + t^2)``.

    Null without a statistic or with no degree of freedom; an infinite
    statistic gives 0."""
    half = F.lit(0.5)
    a, ratio = df / 2, t * t / df
    x, rest = 1 / (1 + ratio), ratio / (1 + ratio)
    front = F.exp(_log_half_step(a, F.ln) - 0.5 * math.log(math.pi) - a * F.log1p(ratio) + 0.5 * F.ln(rest))
    direct = front * _beta_fraction(a, half, x) / a
    mirrored = 1 - front * _beta_fraction(half, a, rest) / 0.5
    p = (F.when(t == 0, 1.0).when(F.abs(t) == float("inf"), 0.0)
         .when(x < (a + 1) / (a + 2.5), direct).otherwise(mirrored))
    return F.when(t.isNotNull() & ~F.isnan(t) & (df > 0), F.greatest(p, F.lit(0.0)))


def t_two_sided_p(t: float, df: float) -> float:
    """The same p-value of single numbers; NaN where the column is null."""
    if t is None or df is None or not math.isfinite(df) or df <= 0 or math.isnan(t):
        return float("nan")
    if t == 0 or math.isinf(t):
        return float(t == 0)
    a, ratio = df / 2, t * t / df
    x, rest = 1 / (1 + ratio), ratio / (1 + ratio)
    front = math.exp(_log_half_step(a, math.log) - 0.5 * math.log(math.pi) - a * math.log1p(ratio) + 0.5 * math.log(rest))
    direct = x < (a + 1) / (a + 2.5)
    p, q, y = (a, 0.5, x) if direct else (0.5, a, rest)
    c = h = d = 1.0
    for m in range(int(30 + 4 * math.sqrt(max(p, q))) + 1):
        terms = [-(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))]
        if m:
            terms.insert(0, m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)))
        for term in terms:
            d, c = 1 / ((1 + term * d) or 1e-300), (1 + term / c) or 1e-300
            if not m:
                c = 1.0
            h *= c * d
    return front * h / a if direct else max(0.0, 1 - front * h / 0.5)
