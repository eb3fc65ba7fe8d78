"""Strategy signals, crosses and conditions as boolean columns; unknown is false, before NOT too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import prev, yes

#: Column prefix of each strategy: its long and short columns are {prefix}_long and {prefix}_short.
STRATEGIES = ("connors", "squeeze", "turtle", "mean_reversion", "rsi", "ma_cross", "bb_breakout", "engulfing")
HYBRIDS = ("sma_adx_strong", "macd_rsi_trend", "pure_trend")
#: Names under which a strategy is also known.
ALIASES = {"ema_adx_strong": "sma_adx_strong"}


def crosses_above(a: str, b: str) -> Column:
    """a passes over b: at most b before, over it now; all four values must be there."""
    return yes((F.col(a) > F.col(b)) & (prev(a) <= prev(b)))


def crosses_below(a: str, b: str) -> Column:
    return yes((F.col(a) < F.col(b)) & (prev(a) >= prev(b)))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, map(yes, conditions))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, map(yes, conditions))


def none_of(condition: Column) -> Column:
    return ~yes(condition)


def first_of_run(condition: str) -> Column:
    """True now and not on the bar before; the first bar of a series counts."""
    return yes(F.col(condition)) & ~yes(prev(condition))


def strategy_signals(bars: DataFrame, rsi_high: float = 70.0, main: str = "sma_200", fast: str = "sma_20", slow: str = "sma_60") -> DataFrame:
    """Adds the sixteen signal columns to a ``strategy_frame``."""
    low, close, rsi = 100 - rsi_high, F.col("close"), F.col("rsi_14")
    up, down = close > F.col(main), close < F.col(main)
    cheap, dear = rsi < low, rsi > rsi_high
    freed = prev("squeeze_on") & ~F.col("squeeze_on")
    o1, c1, o = prev("open"), prev("close"), F.col("open")
    signals = {
        "connors": (up & cheap, down & dear),
        "squeeze": (freed & (close > F.col("bb_mid")), freed & (close < F.col("bb_mid"))),
        "turtle": ((close > F.col("donch_high")) & up, (close < F.col("donch_low")) & down),
        "mean_reversion": (up & (close < F.col("bb_low")) & cheap, down & (close > F.col("bb_up")) & dear),
        "rsi": (cheap, dear),
        "ma_cross": (crosses_above(fast, slow), crosses_below(fast, slow)),
        "bb_breakout": (crosses_above("close", "bb_up"), crosses_below("close", "bb_low")),
        "engulfing": ((c1 < o1) & (close > o) & (o <= c1) & (close >= o1), (c1 > o1) & (close < o) & (o >= c1) & (close <= o1)),
    }
    return bars.withColumns({f"{n}_{side}": yes(c) for n, both in signals.items() for side, c in zip(("long", "short"), both, strict=True)})


def hybrid_signals(bars: DataFrame) -> DataFrame:
    """Adds the three hybrid signals to a ``live_frame``."""
    trend = F.col("close") > F.col("sma_200")
    rules = {
        "sma_adx_strong": (F.col("sma_20") > F.col("sma_50")) & (F.col("adx_14") > 25),
        "macd_rsi_trend": (F.col("macd_hist") > 0) & (F.col("rsi_14") > 55) & trend,
        "pure_trend": trend,
    }
    return bars.withColumns({n: yes(c) for n, c in rules.items()})


def trend_votes(bars: DataFrame) -> DataFrame:
    """Adds votes (-6..6) and bias of a ``trend_frame``: three stochastics, stochastic RSI, VWAP and Supertrend."""

    def vote(a: Column, b: Column) -> Column:
        return F.coalesce(F.signum(a - b).cast("int"), F.lit(0))

    votes = sum(
        (vote(F.col(f"{p}_k"), F.col(f"{p}_d")) for p in ("stoch_5_3_3", "stoch_10_6_6", "stoch_20_12_12", "stoch_rsi")),
        vote(F.col("close"), F.col("vwap")) + F.col("supertrend_dir"),
    )
    out = bars.withColumn("votes", votes)
    return out.withColumn("bias", F.when(F.col("votes") >= 2, "bullish").when(F.col("votes") <= -2, "bearish").otherwise("neutral"))


def line_states(bars: DataFrame, k: str, d: str, name: str) -> DataFrame:
    """Adds {name}_state (golden or dead: which line is above) and {name}_cross, where that changed from the bar before."""
    a, b, pa, pb = F.col(k), F.col(d), prev(k), prev(d)
    return bars.withColumns({
        f"{name}_state": F.when(a > b, "golden").when(a < b, "dead"),
        f"{name}_cross": F.when((pa <= pb) & (a > b), "golden").when((pa >= pb) & (a < b), "dead"),
    })


def hybrid_report(bars: DataFrame) -> DataFrame:
    """Per series and hybrid strategy with a signal: signals, their share of all bars in percent, mean RSI and ADX at them."""
    names = ("sma_adx_strong", "macd_rsi_trend", "pure_trend")
    long = hybrid_signals(bars).select("symbol", "interval", "rsi_14", "adx_14", F.inline(F.array(*[F.struct(F.lit(x).alias("strategy"), F.col(x).alias("on")) for x in names])))
    on = F.col("on")
    out = long.groupBy("symbol", "interval", "strategy").agg(
        F.count_if(on).alias("signals"), (F.count_if(on) / F.count(F.lit(1)) * 100).alias("signal_rate"), F.avg(F.when(on, F.col("rsi_14"))).alias("avg_rsi"), F.avg(F.when(on, F.col("adx_14"))).alias("avg_adx")
    )
    return out.where("signals > 0")
