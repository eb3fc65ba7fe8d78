"""Tails of Student's t and of the binomial as Columns, by the incomplete beta function.

The continued fraction runs for a number of terms that follows the root of the sample size, up to ``TERMS``, so a row takes
constant memory whatever its counts.  The factor before it is put together from terms that stay small, so large counts
lose no digits to differences of large logarithms.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the continued fraction at most; enough for counts of 10^7 at the centre, where it is slowest.
TERMS = 10_000
_TINY = 1e-300


def _let(names: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of named values, each evaluated once."""
    return F.transform(F.array(F.struct(*[c.cast("double").alias(k) for k, c in names.items()])), body)[0]


def _stirling(z: Column) -> Column:
    """What log-gamma is above (z - 1/2) ln z - z + ln(2 pi)/2: ten steps up, then the series."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, j: s + (z + j + 0.5) * F.log1p(1 / (z + j)) - 1)
    w = z + 10
    square = w * w
    return up + (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * square)) / square) / square) / square) / w


def _front(a: Column, b: Column, x: Column, y: Column) -> Column:
    """x^a y^b / B(a, b) for y = 1 - x."""
    n = a + b
    log = 0.5 * F.log(a * b / (2 * math.pi * n)) + _stirling(n) - _stirling(a) - _stirling(b) + a * F.log(x * n / a) + b * F.log(y * n / b)
    return F.when((x > 0) & (y > 0), F.exp(log)).otherwise(0.0)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's rule, two steps a term."""
    held = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    terms = F.least(F.lit(TERMS), 60 + F.floor(4 * F.sqrt(F.greatest(a, b)))).cast("int")
    first = 1 / held(1 - (a + b) * x / (a + 1))

    def step(s: Column, num: Column) -> Column:
        return _let({"d": 1 / held(1 + num * s["d"]), "c": held(1 + num / s["c"]), "h": s["h"]}, lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (n["h"] * n["c"] * n["d"]).alias("h")))

    def term(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return step(step(s, even), odd)

    return F.aggregate(F.sequence(F.lit(1), terms), F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), term, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), given y = 1 - x too; a, b > 0."""

    def both(v: Column) -> Column:
        low = v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2)  # else the fraction is slow, and that of the other tail is not
        side = lambda p, q: F.when(low, v[p]).otherwise(v[q])
        value = _let({"a": side("a", "b"), "b": side("b", "a"), "x": side("x", "y"), "y": side("y", "x")}, lambda s: _front(s["a"], s["b"], s["x"], s["y"]) * _fraction(s["a"], s["b"], s["x"]) / s["a"])
        return F.when(v["x"] <= 0, 0.0).when(v["y"] <= 0, 1.0).when(low, value).otherwise(1 - value)

    return _let({"a": a, "b": b, "x": x, "y": y}, both)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null for a null t or without degrees of freedom."""
    square = t * t
    return F.when(t.isNotNull() & (df > 0), incomplete_beta(df / 2, F.lit(0.5), df / (df + square), square / (df + square)))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Two-sided p of k successes in n trials of chance one half; 1 for n = 0.  Up to 45 trials it is exact."""
    tail = F.least(k, n - k)
    next_ = lambda s, i: F.struct((s["c"] * (n - i) / (i + 1)).alias("c"), (s["sum"] + s["c"]).alias("sum"))  # noqa: E731  whole numbers below 2^53
    ways = F.aggregate(F.sequence(F.lit(0), F.least(tail, F.lit(22)).cast("int")), F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("sum")), next_, lambda s: s["sum"])
    p = F.when(n <= 45, ways / F.pow(F.lit(2.0), n)).otherwise(incomplete_beta(n - tail, tail + 1, F.lit(0.5), F.lit(0.5)))
    return F.when((n == 0) | (2 * tail >= n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * p))


def t_upper(confidence: float, df: Column, rounds: int = 14) -> Column:
    """The t whose two-sided p is 1 - ``confidence``, by Newton's rule from the normal value: p is convex there, so the
    steps come from one side and never pass the root."""
    alpha = 1 - confidence
    start = F.lit(NormalDist().inv_cdf(1 - alpha / 2))

    def step(t: Column, _: Column) -> Column:
        x, y = df / (df + t * t), t * t / (df + t * t)
        slope = 2 * _front(df / 2, F.lit(0.5), x, y) / t  # of p in t, without its sign
        return t + (t_two_sided(t, df) - alpha) / slope

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
