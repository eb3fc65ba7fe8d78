"""Indicators that a bounded window can express, as columns added to a bar table.

All windows are ``series`` frames, so a chain of these functions plans one exchange and one sort.  Values are null until
their window is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.folds import fold
from quantloom.functions.scan import recursive
from quantloom.functions.windows import KEYS, ahead, full, prev, roll

#: Stands for a body or range of 0 where something is divided by it.
TINY = 1e-8


def sma(column: str, n: int) -> Column:
    return full(F.avg(column).over(roll(n)), F.col(column), n)


def moving_averages(bars: DataFrame, lengths: tuple[int, ...] = (5, 20, 50, 200), column: str = "close") -> DataFrame:
    """Adds sma_{n} for each length."""
    return bars.withColumns({f"sma_{n}": sma(column, n) for n in lengths})


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Adds bb_mid, bb_std (sample deviation), bb_up and bb_low."""
    out = bars.withColumns({"bb_mid": sma("close", n), "bb_std": full(F.stddev_samp("close").over(roll(n)), F.col("close"), n)})
    return out.withColumns({"bb_up": F.col("bb_mid") + k * F.col("bb_std"), "bb_low": F.col("bb_mid") - k * F.col("bb_std")})


def band_touches(bars: DataFrame) -> DataFrame:
    """Adds touch_lower, touch_mid and touch_upper to bars with Bollinger bands; false while the bands are null."""
    low, high, mid = F.col("low"), F.col("high"), F.col("bb_mid")
    touches = {"touch_lower": low <= F.col("bb_low"), "touch_mid": (low <= mid) & (mid <= high), "touch_upper": high >= F.col("bb_up")}
    return bars.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in touches.items()})


def rsi_cutler(bars: DataFrame, n: int = 14, name: str = "rsi_sma") -> DataFrame:
    """RSI with plain means; the first bar counts as no change.  Null for a flat window, 100 where nothing was lost."""
    delta = F.coalesce(F.col("close") - prev("close"), F.lit(0.0))
    out = bars.withColumn("_delta", delta)
    out = out.withColumns({"_gain": F.greatest(F.col("_delta"), F.lit(0.0)), "_loss": F.greatest(-F.col("_delta"), F.lit(0.0))})
    out = out.withColumns({"_up": sma("_gain", n), "_down": sma("_loss", n)})
    value = F.when(F.col("_down") > 0, 100 - 100 / (1 + F.col("_up") / F.col("_down"))).when(F.col("_up") > 0, F.lit(100.0))
    return out.withColumn(name, value).drop("_delta", "_gain", "_loss", "_up", "_down")


def true_range() -> Column:
    """High less low on the first bar of a series; ``greatest`` skips the nulls there."""
    last = prev("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def atr_mean(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds tr, atr_sma (plain mean) and atr_pct (percent of the close)."""
    out = bars.withColumn("tr", true_range()).withColumn("atr_sma", sma("tr", n))
    return out.withColumn("atr_pct", F.when(F.col("close") != 0, F.col("atr_sma") / F.col("close") * 100))


def slow_stochastic(bars: DataFrame, n: int = 14, k: int = 3, d: int = 3, prefix: str = "stoch") -> DataFrame:
    """Adds {prefix}_k and {prefix}_d; a window without range has no value."""
    low = full(F.min("low").over(roll(n)), F.col("low"), n)
    span = full(F.max("high").over(roll(n)), F.col("high"), n) - low
    out = bars.withColumn("_fast", F.when(span != 0, 100 * (F.col("close") - low) / span))
    return out.withColumn(f"{prefix}_k", sma("_fast", k)).withColumn(f"{prefix}_d", sma(f"{prefix}_k", d)).drop("_fast")


def vwap(bars: DataFrame, n: int = 20) -> DataFrame:
    """Adds vwap: typical price weighted by volume over n bars; its plain mean where there is no volume column."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    if "volume" not in bars.columns:
        return bars.withColumn("_tp", typical).withColumn("vwap", sma("_tp", n)).drop("_tp")
    out = bars.withColumn("_tp", typical).withColumn("_tpv", typical * F.col("volume"))
    value = F.sum("_tpv").over(roll(n)) / (F.sum("volume").over(roll(n)) + 1e-10)
    return out.withColumn("vwap", full(value, F.col("_tpv"), n)).drop("_tp", "_tpv")


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    """Adds donch_high and donch_low over the n bars before the current one."""
    before = ahead(-n, -1)
    return bars.withColumns({"donch_high": full(F.max("high").over(before), F.col("high"), n, before), "donch_low": full(F.min("low").over(before), F.col("low"), n, before)})


def volume_spike(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Adds vol_ma and vol_spike (volume over k times its mean; false while there is no mean)."""
    out = bars.withColumn("vol_ma", sma("volume", n))
    return out.withColumn("vol_spike", F.coalesce(F.col("volume") > k * F.col("vol_ma"), F.lit(False)))


def disparity(bars: DataFrame, n: int = 20) -> DataFrame:
    """Adds disparity (close in percent of its mean) and vol_change (percent change of the volume)."""
    mean, last = sma("close", n), prev("volume")
    return bars.withColumns({"disparity": F.when(mean != 0, F.col("close") / mean * 100), "vol_change": F.when(last != 0, (F.col("volume") / last - 1) * 100)})


def keltner(bars: DataFrame, k: float = 1.5, atr: str = "atr_20") -> DataFrame:
    """Adds kc_up, kc_low and squeeze_on to bars with Bollinger bands and an ATR column."""
    out = bars.withColumns({"kc_up": F.col("bb_mid") + k * F.col(atr), "kc_low": F.col("bb_mid") - k * F.col(atr)})
    return out.withColumn("squeeze_on", F.coalesce((F.col("bb_up") < F.col("kc_up")) & (F.col("bb_low") > F.col("kc_low")), F.lit(False)))


def candles(bars: DataFrame) -> DataFrame:
    """Adds is_bull, is_bear, body, range (each at least ``TINY`` where 0), wicks and body_rel."""
    o, h, low, c = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    body, span = F.abs(c - o), h - low
    out = bars.withColumns({
        "is_bull": c > o,
        "is_bear": c < o,
        "body": F.when(body == 0, F.lit(TINY)).otherwise(body),
        "range": F.when(span == 0, F.lit(TINY)).otherwise(span),
        "upper_wick": h - F.greatest(o, c),
        "lower_wick": F.least(o, c) - low,
    })
    return out.withColumn("body_rel", F.col("body") / F.col("range"))


def directional(bars: DataFrame, direction: str = "green") -> DataFrame:
    """Adds is_green, is_red, body_pct (percent of the open, positive in the direction) and target_bit."""
    sign = 1.0 if direction == "green" else -1.0
    green, red = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    pct = F.when(F.col("open") != 0, sign * (F.col("close") - F.col("open")) / F.col("open") * 100)
    return bars.withColumns({"is_green": green, "is_red": red, "body_pct": pct, "target_bit": green if sign > 0 else red})


def regime(bars: DataFrame, main: str = "sma_200", adx: str = "adx_14", level: float = 25.0) -> DataFrame:
    """Adds regime: Sideways while ADX is low or unknown, else Bull or Bear by the close against the main mean."""
    strong = F.col(adx) >= level
    value = F.when(strong & (F.col("close") > F.col(main)), "Bull").when(strong & (F.col("close") <= F.col(main)), "Bear").otherwise("Sideways")
    return bars.withColumn("regime", value)


def daily_ema(bars: DataFrame, span: int = 200, lag_days: int = 0) -> DataFrame:
    """Adds daily_ema: the exponential mean of daily last closes, looked up by date.

    With ``lag_days`` 0 a bar sees its own day's final close; 1 uses days that have ended.  The daily table has one row
    per series and day and is joined on both.
    """
    day = F.to_date("open_dt")
    days = bars.groupBy("symbol", "interval", day.alias("open_dt")).agg(F.max_by("close", "open_dt").alias("close"))
    name = f"ema_{span}"
    means = recursive(days, [name]).select(*KEYS, F.col("open_dt").alias("_day"), F.col(name).alias("daily_ema"))
    if lag_days:
        means = means.withColumn("daily_ema", F.lag("daily_ema", lag_days).over(Window.partitionBy(*KEYS).orderBy("_day")))
    return bars.withColumn("_day", day).join(means, [*KEYS, "_day"], "left").drop("_day")


def strategy_frame(bars: DataFrame, main: int = 200, fast: int = 20, slow: int = 60, adx_level: float = 25.0, donch: int = 20, bb: int = 20, bb_k: float = 2.0, kc_k: float = 1.5) -> DataFrame:
    """All columns that the strategy signals read.  Recursive ones come from a single pass over each series,
    in the partitioning that the windows need anyway."""
    out = fold(bars, ["adx_14", "rsi_14", "macd", "atr_20"])
    out = moving_averages(out, tuple(dict.fromkeys((main, fast, slow, 200))))
    out = volume_spike(donchian(keltner(bollinger(out, bb, bb_k), kc_k), donch))
    return regime(out, f"sma_{main}", level=adx_level)


def live_frame(bars: DataFrame) -> DataFrame:
    """Columns of the live view: four means, MACD histogram, RSI, ADX, ATR and ATR in percent."""
    out = moving_averages(fold(bars, ["macd", "rsi_14", "adx_14", "atr_14"]), (20, 50, 100, 200))
    return out.withColumn("atr_pct", F.when(F.col("close") != 0, F.col("atr_14") / F.col("close") * 100))


def trend_frame(bars: DataFrame) -> DataFrame:
    """Columns of the trend view: stochastic RSI, VWAP, Supertrend and three slow stochastics."""
    out = vwap(fold(bars, ["stoch_rsi", "supertrend"]))
    for n, k, d in ((5, 3, 3), (10, 6, 6), (20, 12, 12)):
        out = slow_stochastic(out, n, k, d, f"stoch_{n}_{k}_{d}")
    return out


def frame_for(bars: DataFrame, mode: str = "backtest", **parameters) -> DataFrame:
    """The columns that one kind of study reads: backtest, trend (on top of those), or live."""
    if mode == "backtest":
        return strategy_frame(bars, **parameters)
    if mode == "trend":
        return trend_frame(strategy_frame(bars, **parameters))
    if mode == "live":
        return live_frame(bars)
    raise ValueError(f"unknown mode: {mode}")


def streak_frame(bars: DataFrame, direction: str = "green") -> DataFrame:
    """The columns that streak studies read: colours and bodies, RSI, ATR in percent, disparity and volume change."""
    return disparity(atr_mean(rsi_cutler(directional(bars, direction))))


def series_returns(bars: DataFrame, periods: float = 252.0) -> DataFrame:
    """Per series: bars up and down, mean candle and close returns, total return and annualised Sharpe ratio."""
    out = bars.withColumns({"_candle": F.when(F.col("open") != 0, F.col("close") / F.col("open") - 1), "_ret": F.when(prev("close") != 0, F.col("close") / prev("close") - 1)})
    sd = F.stddev_samp("_ret")
    first, last = F.min_by("open", "open_dt"), F.max_by("close", "open_dt")
    return out.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.count_if(F.col("close") > F.col("open")).alias("n_up"),
        F.count_if(F.col("close") < F.col("open")).alias("n_down"),
        F.avg("_candle").alias("mean_candle"),
        F.avg("_ret").alias("mean_return"),
        F.when(first != 0, last / first - 1).alias("total_return"),
        F.when(sd != 0, F.avg("_ret") / sd * F.sqrt(F.lit(periods))).alias("sharpe"),
    )
