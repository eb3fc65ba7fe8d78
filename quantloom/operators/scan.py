"""Latest-bar views for all series at once: scanners, dashboards, and prices that would bring an indicator to a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scan import recursive
from quantloom.functions.windows import KEYS
from quantloom.operators.indicators import live_frame, strategy_frame, trend_frame
from quantloom.operators.signals import STRATEGIES, hybrid_signals, strategy_signals, trend_votes


def latest(bars: DataFrame, n: int = 1, skip: int = 0) -> DataFrame:
    """The last n bars of each series after leaving out the newest ``skip`` (1 leaves out the bar in progress)."""
    out = bars.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("open_dt"))))
    return out.where((F.col("_n") > skip) & (F.col("_n") <= skip + n)).drop("_n")


def tail(bars: DataFrame, columns: list[str], n: int = 500) -> DataFrame:
    """The last n bars of each series with its keys, open_dt and those of the ``columns`` that exist, in the order asked for."""
    there = [c for c in dict.fromkeys(columns) if c in bars.columns and c not in (*KEYS, "open_dt")]
    return latest(bars.select(*KEYS, "open_dt", *[f"`{c}`" for c in there]), n)


def strategy_scan(bars: DataFrame, skip: int = 1, **parameters) -> DataFrame:
    """(symbol, interval, open_dt, strategy, long, short): which strategies signal on each series' latest closed bar."""
    last = latest(strategy_signals(strategy_frame(bars, **parameters), main=f"sma_{parameters.get('main', 200)}"), skip=skip)
    rows = F.inline(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"{s}_long").alias("long"), F.col(f"{s}_short").alias("short")) for s in STRATEGIES]))
    return last.select(*KEYS, "open_dt", rows)


def preset_scan(bars: DataFrame, presets: DataFrame, **parameters) -> DataFrame:
    """Presets (name, coin, interval, strat_id, direction) with ``on``: whether their signal is on in their series' latest closed bar."""
    found = strategy_scan(bars, **parameters)
    p = presets.select("name", F.col("coin").alias("symbol"), "interval", F.lower("strat_id").alias("strategy"), F.lower("direction").alias("direction"))
    joined = p.join(found, ["symbol", "interval", "strategy"])
    return joined.withColumn("on", F.when(F.col("direction") == "short", F.col("short")).otherwise(F.col("long"))).drop("long", "short")


#: The parts of each hybrid rule, over the columns of a ``live_frame``.
HYBRID_PARTS = {
    "sma_adx_strong": {"sma_20 above sma_50": "sma_20 > sma_50", "adx above 25": "adx_14 > 25"},
    "macd_rsi_trend": {"macd_hist above 0": "macd_hist > 0", "rsi above 55": "rsi_14 > 55", "close above sma_200": "close > sma_200"},
    "pure_trend": {"close above sma_200": "close > sma_200"},
}


def hybrid_live(bars: DataFrame, skip: int = 1) -> DataFrame:
    """(symbol, interval, open_dt, close, strategy, is_active, part, holds): each hybrid rule and its parts on the latest
    closed bar; a part that is not known yet is null, and its rule is off.  A series of one bar has no rows."""
    last = latest(hybrid_signals(live_frame(bars)), skip=skip)
    rows = [F.struct(F.lit(s).alias("strategy"), F.col(s).alias("is_active"), F.lit(name).alias("part"), F.expr(c).alias("holds")) for s, parts in HYBRID_PARTS.items() for name, c in parts.items()]
    return last.select(*KEYS, "open_dt", "close", F.inline(F.array(*rows)))


def dashboard(bars: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` bars of each series with the columns of the live and the trend view, votes and bias; is_latest marks
    the bar in progress."""
    out = latest(trend_votes(trend_frame(live_frame(bars))), n)
    newest = F.max("open_dt").over(Window.partitionBy(*KEYS))
    return out.withColumn("is_latest", F.col("open_dt") == newest)


def _price_for_rsi(target: float, n: int = 14) -> Column:
    """Next close that makes Wilder's RSI the target, from the two mean states."""
    rs, up, down, close = target / (100 - target), F.col("avg_gain") * (n - 1), F.col("avg_loss") * (n - 1), F.col("close")
    gain, loss = rs * down - up, up / F.lit(rs) - down
    return F.when(gain >= 0, close + gain).when(loss >= 0, close - loss).otherwise(close)


def projections(bars: DataFrame, k: int = 5, min_bars: int = 20) -> DataFrame:
    """Per series of ``min_bars`` or more: the next close that would bring RSI to 30 and 70 and %K to 20 and 80."""
    recent = Window.partitionBy(*KEYS).orderBy("open_dt").rowsBetween(-(k - 2), 0)
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    out = recursive(bars, ["rma_state"]).withColumns({"stoch_hh": F.max("high").over(recent), "stoch_ll": F.min("low").over(recent), "_bars": n})
    last = latest(out.where(F.col("_bars") >= min_bars))
    at = lambda x: F.col("stoch_ll") + x * (F.col("stoch_hh") - F.col("stoch_ll"))
    return last.select(*KEYS, "close", _price_for_rsi(30.0).alias("rsi_30"), _price_for_rsi(70.0).alias("rsi_70"), at(0.2).alias("stoch_20"), at(0.8).alias("stoch_80"), "stoch_hh", "stoch_ll")
