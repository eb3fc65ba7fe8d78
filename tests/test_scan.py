"""Block scans against the one-pass folds and against pandas."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from helpers import bars, wave

from pyspark.sql import functions as F

from quantloom.functions import folds, scan

NAMES = ["ema_12", "ema_200", "rsi_14", "atr_14", "atr_20", "adx_14", "macd", "stoch_rsi", "rma_state"]


def _frame(df):
    return df.toPandas().sort_values(["symbol", "open_dt"], na_position="first").reset_index(drop=True)


def _series(spark, missing):
    rng = random.Random(4)
    hole = lambda x: float("nan") if rng.random() < missing else x
    rows = [(o, hole(h), hole(low), hole(c), v) for o, h, low, c, v in wave(700)]
    rows[100:140] = [(o, float("nan"), float("nan"), float("nan"), v) for o, _, _, _, v in rows[100:140]]
    flat = [(5, 5, 5, 5)] * 60
    late = [(1, float("nan"), float("nan"), float("nan"))] * 30 + rows[200:260]
    out = bars(spark, rows, "A").union(bars(spark, flat, "B")).union(bars(spark, late, "C")).union(bars(spark, rows[:1], "D")).union(bars(spark, wave(20), "E", "odd"))
    return out.withColumns({c: F.when(F.col("symbol") != "C", F.col(c)).otherwise(F.nanvl(c, F.lit(None).cast("double"))) for c in ("high", "low", "close")})


@pytest.mark.parametrize(("missing", "block"), [(0.0, 256), (0.2, 256), (0.2, 7), (0.0, 1)])
def test_scan_equals_fold(spark, monkeypatch, missing, block):
    """Null and NaN prices, long gaps, late starts; blocks of one bar up to whole series."""
    monkeypatch.setattr(scan, "BLOCK", block)
    df = _series(spark, missing)
    got, want = _frame(scan.recursive(df, NAMES)), _frame(folds.fold(df, NAMES))
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9)


def test_means_across_many_blocks(spark, monkeypatch):
    """More blocks than the fold takes in one piece, and a gap of several blocks."""
    monkeypatch.setattr(scan, "BLOCK", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(100, 5, 1500)
    x[300:420] = np.nan
    df = bars(spark, [(1, 1, 1, v) for v in x])
    out = scan.with_means(scan.blocked(df), [scan.ema("e", "close", 30), scan.rma("w", "close", 14)])
    assert out.select("_block", "_part").distinct().count() > 512
    got = _frame(out)
    np.testing.assert_allclose(got["e"], folds.ema(pd.Series(x), 30), rtol=1e-12)
    np.testing.assert_allclose(got["w"], folds.rma(pd.Series(x), 14), rtol=1e-12)


def test_one_series_is_many_tasks_without_python(spark):
    df = bars(spark, wave(3000))
    out = scan.recursive(df, NAMES)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    assert scan.blocked(df).select("_block").distinct().count() >= 12
    assert scan.blocked(df).groupBy("_block", "_part").count().agg(F.max("count")).first()[0] <= scan.BLOCK


def test_null_keys_and_empty_tables(spark):
    df = bars(spark, wave(40)).withColumn("symbol", F.lit(None).cast("string"))
    assert scan.recursive(df, ["ema_12"]).where("ema_12 IS NOT NULL").count() == 40
    assert scan.recursive(df.limit(0), NAMES).count() == 0


def test_unknown_names_and_weights():
    with pytest.raises(ValueError):
        scan._parsed("sma_3")
    with pytest.raises(ValueError):
        scan.ema("e", "close", 1)
