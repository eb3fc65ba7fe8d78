"""Recursive indicators (exponential means and what builds on them) in one grouped fold per series.

A bounded window cannot carry the state, so all recursive columns of a pipeline are computed in a single
``applyInPandas`` pass over each series: one shuffle by (symbol, interval), linear time, in the partitioning that the
series windows of the same pipeline need.  ``scan.recursive`` has the linear ones without Python and for long series.  Values stay float64 from Arrow to
Arrow; a value that is not there yet is NaN inside the pass and null outside.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ema(x: pd.Series, span: int) -> pd.Series:
    return x.ewm(span=span, adjust=False).mean()


def rma(x: pd.Series, n: int) -> pd.Series:
    """Wilder's mean: null until n values were seen."""
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def rsi(close: pd.Series, n: int = 14) -> pd.Series:
    """Wilder's index: 100 g / (g + l) of the mean gain g and mean loss l; 0 where nothing was gained."""
    step = np.diff(close.to_numpy(dtype=float), prepend=np.nan)
    gain = rma(pd.Series(np.where(np.isnan(step), np.nan, np.maximum(step, 0.0)), index=close.index), n)
    loss = rma(pd.Series(np.where(np.isnan(step), np.nan, np.maximum(-step, 0.0)), index=close.index), n)
    both = gain + loss
    return (100 * gain / both.where(both != 0)).mask(both == 0, 0.0)


def true_range(b: pd.DataFrame) -> pd.Series:
    last = b["close"].shift(1)
    return pd.concat([b["high"] - b["low"], (b["high"] - last).abs(), (b["low"] - last).abs()], axis=1).max(axis=1)


def atr(b: pd.DataFrame, n: int = 14) -> pd.Series:
    return rma(true_range(b), n)


def adx(b: pd.DataFrame, n: int = 14) -> pd.Series:
    up, down = b["high"].diff(), -b["low"].diff()
    range_ = atr(b, n)
    range_ = range_.where(range_ != 0)
    plus = 100 * rma(up.where((up > down) & (up > 0), 0.0), n) / range_
    minus = 100 * rma(down.where((down > up) & (down > 0), 0.0), n) / range_
    both = plus + minus
    return rma(100 * (plus - minus).abs() / both.where(both != 0), n)


def stoch_rsi(close: pd.Series, n: int = 14, k: int = 3, d: int = 3) -> tuple[pd.Series, pd.Series]:
    r = rsi(close, n)
    low, high = r.rolling(n).min(), r.rolling(n).max()
    fast = (100 * (r - low) / (high - low + 1e-10)).rolling(k).mean()
    return fast, fast.rolling(d).mean()


def supertrend(b: pd.DataFrame, n: int = 10, multiplier: float = 3.0) -> tuple[pd.Series, pd.Series]:
    """(line, direction): the line follows a band that only tightens while the trend holds."""
    close = b["close"].to_numpy()
    middle = ((b["high"] + b["low"]) / 2).to_numpy()
    width = multiplier * true_range(b).ewm(alpha=1 / n, adjust=False).mean().to_numpy()
    line = np.full(len(b), np.nan)
    upper = lower = 0.0
    falling = True  # the line is the upper band
    for i in range(n - 1, len(b)):
        high, low = middle[i] + width[i], middle[i] - width[i]
        if i >= n:
            upper = high if high < upper or close[i - 1] > upper else upper
            lower = low if low > lower or close[i - 1] < lower else lower
            falling = close[i] <= upper if falling or upper <= lower else close[i] < lower
        else:
            upper, lower = high, low
        line[i] = upper if falling else lower
    return pd.Series(line, index=b.index), pd.Series(np.where(close > line, 1, -1), index=b.index)


#: Name of a set of recursive columns -> (columns, function of a series in time order).
FOLDS: dict[str, tuple[tuple[str, ...], Callable[[pd.DataFrame], list]]] = {
    "ema_12": (("ema_12",), lambda b: [ema(b["close"], 12)]),
    "ema_20": (("ema_20",), lambda b: [ema(b["close"], 20)]),
    "ema_200": (("ema_200",), lambda b: [ema(b["close"], 200)]),
    "macd": (("macd", "macd_signal", "macd_hist"), lambda b: _macd(b["close"])),
    "rsi_14": (("rsi_14",), lambda b: [rsi(b["close"])]),
    "atr_14": (("atr_14",), lambda b: [atr(b)]),
    "atr_20": (("atr_20",), lambda b: [atr(b, 20)]),
    "adx_14": (("adx_14",), lambda b: [adx(b)]),
    "stoch_rsi": (("stoch_rsi_k", "stoch_rsi_d"), lambda b: list(stoch_rsi(b["close"]))),
    "supertrend": (("supertrend", "supertrend_dir"), lambda b: list(supertrend(b))),
    "rma_state": (("avg_gain", "avg_loss"), lambda b: [rma(b["close"].diff().clip(lower=0.0), 14), rma(-b["close"].diff().clip(upper=0.0), 14)]),
}


def _macd(close: pd.Series, fast: int = 12, slow: int = 26, signal: int = 9) -> list[pd.Series]:
    line = ema(close, fast) - ema(close, slow)
    mean = ema(line, signal)
    return [line, mean, line - mean]


def fold(bars: DataFrame, names: list[str]) -> DataFrame:
    """``bars`` with the columns of the named folds, all in one pass; values that are not there yet are null."""
    columns = [c for n in names for c in FOLDS[n][0]]
    schema = T.StructType([*bars.schema.fields, *[T.StructField(c, T.IntegerType() if c == "supertrend_dir" else T.DoubleType()) for c in columns]])

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("open_dt", kind="stable").reset_index(drop=True)
        values = [v for n in names for v in FOLDS[n][1](series)]
        return pd.concat([series, pd.DataFrame(dict(zip(columns, values, strict=True)))], axis=1)

    return bars.groupBy("symbol", "interval").applyInPandas(run, schema)
