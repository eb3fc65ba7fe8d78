"""Proportions and return statistics as Column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import tails

P_FLOOR = 1e-16


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson bounds in percent, held within 0..100; null for n = 0."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), (centre - half) * 100), F.least(F.lit(100.0), (centre + half) * 100)
    return F.when(n > 0, low), F.when(n > 0, high)


def binomial_p(k: Column, n: Column) -> Column:
    """Two-sided exact p of k successes in n trials of chance one half; 1 for n = 0."""
    return tails.binomial_two_sided(k, n)


def floored(p: Column) -> Column:
    return F.greatest(p, F.lit(P_FLOOR))


def is_floored(p: Column) -> Column:
    """Whether ``floored`` raised a p; null for null."""
    return p < P_FLOOR


def bonferroni(tests: Column | int, alpha: float = 0.05) -> Column:
    """Significance level for each of several tests, to four places."""
    return F.bround(F.lit(alpha) / tests, 4)


def reliability(n: Column) -> Column:
    return F.when(n >= 30, "high").when(n >= 10, "medium").otherwise("low")


def p_label(p: Column) -> Column:
    """How far a p-value can be relied on, in words; N/A for null."""
    # Bounds and labels.
    return F.when(p < 0.01, "Very High").when(p < 0.05, "High").when(p < 0.1, "Medium").when(p.isNotNull(), "Low").otherwise("N/A")


def edge_score(rate: Column, p: Column, n: Column) -> Column:
    """0..100, to two places: 0.45 distance from even odds, 0.25 significance (none for a null p), 0.20 sample size up to
    120, 0.10 reliability; 0 for a null rate or an empty sample."""
    edge = F.least(F.lit(100.0), F.abs(rate - 50) * 2)
    significance = F.coalesce((1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))) * 100, F.lit(0.0))
    grade = F.when(n >= 30, 90.0).when(n >= 10, 65.0).otherwise(35.0)  # fixed values
    score = edge * 0.45 + significance * 0.25 + F.least(F.lit(100.0), n / 120 * 100) * 0.20 + grade * 0.10
    return F.when(rate.isNull() | ~(n > 0), F.lit(0.0)).otherwise(F.round(F.least(F.lit(100.0), score), 2))


def sharpe(pnl: str, periods: float = 252.0) -> Column:
    """Mean over sample deviation, annualised; null where the deviation is 0."""
    sd = F.stddev_samp(pnl)
    return F.when(sd != 0, F.avg(pnl) / sd * math.sqrt(periods))


def sortino(pnl: str, periods: float = 252.0) -> Column:
    sd = F.stddev_samp(F.when(F.col(pnl) < 0, F.col(pnl)))
    return F.when(sd != 0, F.avg(pnl) / sd * math.sqrt(periods))


def profit_factor(pnl: str) -> Column:
    """Sum of wins over sum of losses; null without losses."""
    lost = F.sum(F.when(F.col(pnl) < 0, -F.col(pnl)))
    return F.when(lost > 0, F.coalesce(F.sum(F.when(F.col(pnl) > 0, F.col(pnl))), F.lit(0.0)) / lost)


def t_statistic(pnl: str) -> Column:
    """One-sample t of the mean against 0."""
    sd = F.stddev_samp(pnl)
    return F.when(sd > 0, F.avg(pnl) / (sd / F.sqrt(F.count(pnl))))


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided_p(t: float | None, df: float) -> float | None:
    """Two-sided p of Student's t with ``df`` degrees of freedom."""
    if t is None or df <= 0:
        return None
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t: P(T <= t) = p for p >= 0.5."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - t_two_sided_p(mid, df) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def with_t_test(df: DataFrame, t: str, n: str, name: str = "p_value") -> DataFrame:
    """``df`` with the two-sided p of column ``t`` for ``n`` values."""
    return df.withColumn(name, tails.t_two_sided(F.col(t), F.col(n) - 1))


def with_mean_interval(df: DataFrame, mean: str, sd: str, n: str, confidence: float = 0.95) -> DataFrame:
    """``df`` with ci_lower, ci_upper and ci_width of a mean by Student's t; both ends are the mean without deviation or below two values."""
    half = F.when((F.col(n) >= 2) & (F.col(sd) > 0), tails.t_upper(confidence, (F.col(n) - 1).cast("double")) * F.col(sd) / F.sqrt(F.col(n))).when(F.col(mean).isNotNull(), F.lit(0.0))
    out = df.withColumn("_half", half)
    return out.withColumns({"ci_lower": F.col(mean) - F.col("_half"), "ci_upper": F.col(mean) + F.col("_half"), "ci_width": 2 * F.col("_half")}).drop("_half")
