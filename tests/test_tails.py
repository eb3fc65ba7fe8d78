"""Tails in Columns against exact sums, known values and the normal limit."""

from __future__ import annotations

import math

import pytest

from pyspark.sql import functions as F

from quantloom.functions import stats, tails


def test_t_two_sided(spark):
    rows = [(t, float(d)) for t in (0.0, 0.3, 1.0, 2.0, 5.0, 30.0) for d in (1, 2, 3, 10, 100)]
    for r in spark.createDataFrame(rows, "t double, df double").withColumn("p", tails.t_two_sided(F.col("t"), F.col("df"))).collect():
        assert r.p == pytest.approx(stats.t_two_sided_p(r.t, r.df), abs=1e-13)
    got = spark.createDataFrame([(None, 3.0), (1.0, 0.0), (-2.0, 10.0), (1.0, 1e7)], "t double, df double").select(tails.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert got[0].p is None and got[1].p is None
    assert got[2].p == pytest.approx(0.0733880, abs=1e-7) and got[3].p == pytest.approx(math.erfc(1 / math.sqrt(2)), abs=1e-7)


def test_binomial_is_exact(spark):
    rows = [(k, n) for n in (0, 1, 2, 5, 8, 30, 45, 46, 200, 2001) for k in {0, 1, n // 3, n // 2, n // 2 + 1, n} if k <= n]
    for r in spark.createDataFrame(rows, "k long, n long").withColumn("p", tails.binomial_two_sided(F.col("k"), F.col("n"))).collect():
        tail = min(r.k, r.n - r.k)
        want = min(1.0, 2 * sum(math.comb(r.n, i) for i in range(tail + 1)) / 2**r.n)
        assert r.p == want if r.n <= 45 else r.p == pytest.approx(want, abs=1e-12)


def test_counts_of_ten_million(spark):
    n = 10**7
    got = spark.createDataFrame([(n // 2 - d,) for d in (1, 500, 3000, 20000)], "k long").withColumn("p", tails.binomial_two_sided(F.col("k"), F.lit(n))).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc((n / 2 - r.k - 0.5) / math.sqrt(n / 4) / math.sqrt(2)), rel=1e-4, abs=1e-8)
    terms = F.size(F.sequence(F.lit(1), F.least(F.lit(tails.TERMS), F.lit(10**9))))
    assert spark.range(1).select(terms.alias("n")).first().n == tails.TERMS


@pytest.mark.parametrize("df", [1, 2, 3, 30, 1000])
def test_t_upper_is_the_inverse(spark, df):
    one = spark.range(1).withColumn("df", F.lit(float(df)))
    for confidence in (0.8, 0.95, 0.999):
        assert one.select(tails.t_upper(confidence, F.col("df"))).first()[0] == pytest.approx(stats.t_quantile(1 - (1 - confidence) / 2, df), rel=1e-8)
