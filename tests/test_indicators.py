"""Invariants and edge cases of indicators, patterns, levels and streaks."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import START, bars, wave

from pyspark.sql import functions as F

from quantloom.functions import folds
from quantloom.functions.stats import binomial_p, t_quantile, t_two_sided_p, wilson
from quantloom.operators import indicators as I
from quantloom.operators import joins as J
from quantloom.operators import levels as L
from quantloom.operators import patterns as P
from quantloom.operators import streak as K
from quantloom.operators.signals import all_of, any_of, none_of, strategy_signals


def _all(df):
    out = strategy_signals(I.strategy_frame(I.rsi_cutler(I.slow_stochastic(I.vwap(df))), main=20, slow=30), main="sma_20", slow="sma_30")
    return P.patterns(L.swings(out))


def _sorted(df):
    return df.orderBy("symbol", "open_dt").toPandas().reset_index(drop=True)


def test_later_bars_change_nothing(spark):
    rows = wave(80)
    whole, part = _sorted(_all(bars(spark, rows))), _sorted(_all(bars(spark, rows[:50])))
    pd.testing.assert_frame_equal(whole.iloc[:50], part, check_exact=False, rtol=1e-9, check_dtype=False)


def test_series_do_not_meet(spark):
    a, b = bars(spark, wave(60), "A"), bars(spark, wave(60, 500.0), "B")
    both = _sorted(_all(a.union(b).repartition(7)))
    alone = pd.concat([_sorted(_all(a)), _sorted(_all(b))], ignore_index=True)
    pd.testing.assert_frame_equal(both, alone, check_exact=False, rtol=1e-9, check_dtype=False)


@pytest.mark.parametrize("n", [0, 1, 13, 14])
def test_short_series(spark, n):
    out = _all(bars(spark, wave(n)))
    assert out.count() == n
    assert out.where("rsi_14 IS NOT NULL OR sma_20 IS NOT NULL").count() == 0


def test_flat_prices(spark):
    out = I.slow_stochastic(I.rsi_cutler(folds.fold(bars(spark, [(5, 5, 5, 5)] * 40), ["rsi_14"]))).orderBy(F.desc("open_dt")).first()
    assert out.rsi_14 == 0 and out.rsi_sma is None and out.stoch_k is None


def test_rsi_formula():
    close = pd.Series([1.2, -0.8, 0.9, -0.6, 1.1, -0.7, 0.5, -0.4] * 20).cumsum() + 100
    up = close.diff().clip(lower=0)
    down = -close.diff().clip(upper=0)
    a, b = up.iloc[1], down.iloc[1]
    want = []
    for g, d in zip(up.iloc[2:], down.iloc[2:], strict=True):
        a, b = a * 13 / 14 + g / 14, b * 13 / 14 + d / 14
        want.append(100 - 100 / (1 + a / b))
    np.testing.assert_allclose(folds.rsi(close).iloc[14:], want[12:], rtol=1e-10)


def test_mean_after_a_gap_decays():
    x = pd.Series([1.0, np.nan, np.nan, 4.0])
    a = 0.5
    old, new = (1 - a) ** 3, a
    assert folds.rma(x, 2).iloc[3] == pytest.approx((old * 1 + new * 4) / (old + new))


def test_conditions_take_unknown_as_false(spark):
    df = spark.createDataFrame([(None,)], "x double")
    x = F.col("x")
    assert df.select(none_of(x > 1), all_of(x > 1), any_of(x > 1, F.lit(True))).first()[:] == (True, False, True)


def test_sequence_and_streak(spark):
    df = bars(spark, [(1, 3, 1, 2), (2, 4, 2, 3), (3, 4, 1, 2), (2, 3, 1, 2), (2, 4, 2, 3)])
    hits = [r.matched for r in P.sequence_match(df, [1, 1, -1]).orderBy("open_dt").collect()]
    assert hits == [False, False, True, False, False]  # a doji matches neither colour
    runs = [r.matched for r in P.streak_match(I.directional(df), 2).orderBy("open_dt").collect()]
    assert runs == [False, True, False, False, False]
    with pytest.raises(ValueError):
        P.sequence_match(df, [0, 1])


def test_next_bar_of_a_match_is_the_following_bar(spark):
    df = bars(spark, [(100 + 0.5 * i, 103 + 0.5 * i, 99 + 0.5 * i, 102 + 0.5 * i) for i in range(30)])
    row = K.streak_odds(P.streak_match(I.directional(df), 5)).first()
    assert (row.cases, row.n, row.k) == (26, 25, 25)


def test_no_match_is_a_row_of_zeros(spark):
    row = K.streak_odds(P.streak_match(I.directional(bars(spark, [(2, 3, 1, 1)] * 4)), 3)).first()
    assert (row.cases, row.n, row.rate, row.p_value) == (0, 0, None, 1.0)


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.0,), (30.0,), (100.0,), (101.0,)], "x double")
    got = df.select(K.bin_no(F.col("x"), K.RSI_BINS), K.bin_no(F.col("x"), K.RSI_BINS, lowest=True), K.bin_no(F.col("x"), K.RSI_BINS, "left")).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0), (0, 0, 1), (6, 6, 6), (None, None, None)]


def test_swings_with_ties_and_clusters(spark):
    df = bars(spark, [(1, h, 1, 1) for h in (1, 2, 3, 3, 2, 1, 1, 1)])
    out = [(r.swing_high, r.swing_high_price) for r in L.swings(df, 1).orderBy("open_dt").collect()]
    assert out[3] == (True, 3.0) and out[4] == (True, 3.0) and out[1][0] is False
    prices = spark.createDataFrame([("X", "k", p) for p in (100.0, 100.2, 100.4, 110.0)], "symbol string, kind string, price double")
    got = sorted((round(r.price, 6), r.touches) for r in L.cluster_prices(prices, 0.003).collect())
    assert got == [(100.2, 3), (110.0, 1)]


def test_asof_keeps_a_matched_null(spark):
    left = bars(spark, wave(6))
    right = bars(spark, wave(2), step=3).withColumn("v", F.when(F.col("open_dt") == F.lit(START), F.lit(7.0)))
    got = [r.v_h for r in J.asof(left, right, ["v"], "h").orderBy("open_dt").collect()]
    assert got == [7.0] * 3 + [None] * 3
    before = J.asof(left, right.where(F.col("open_dt") > F.lit(START)), ["v"], "h")
    assert before.count() == 6


def test_intraday_parts_follow_summer_time(spark):
    day = lambda d, h: (dt.datetime(2024, *d) + dt.timedelta(hours=h))
    rows = [("X", "4h", day(d, h), 10.0, 10.0 + (h == 16), 9.0 - (h == 0), 10.0, 1.0) for d in ((1, 10), (7, 10)) for h in (0, 4, 8, 12, 16, 20)]
    df = spark.createDataFrame(rows, "symbol string, interval string, open_dt timestamp_ntz, open double, high double, low double, close double, volume double")
    got = {r.part: (r.lows, r.highs) for r in K.intraday_extremes(df).collect()}
    assert got[4] == (1, 0) and got[5] == (1, 0)  # 19:00 in winter, 20:00 in summer
    assert got[2] == (0, 1) and got[3] == (0, 1)  # 11:00 and 12:00


def test_proportions(spark):
    df = spark.createDataFrame([(60, 100), (0, 0), (100, 100), (0, 100), (50, 100)], "k int, n int")
    low, high = wilson(F.col("k"), F.col("n"))
    got = df.select(low, high, binomial_p(F.col("k"), F.col("n"))).collect()
    assert got[0][2] == pytest.approx(0.0568879336, abs=1e-9) and got[1] == (None, None, 1.0) and got[4][2] == pytest.approx(1.0)
    assert 50 < got[0][0] < 60 < got[0][1] < 70 and got[2][1] == 100 and got[3][0] == 0


def test_student_t():
    assert t_two_sided_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)
    assert t_two_sided_p(0.0, 5) == 1.0 and t_two_sided_p(None, 5) is None
