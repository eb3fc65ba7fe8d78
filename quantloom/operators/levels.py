"""Support and resistance: confirmed swings, price clusters, daily pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import KEYS, ahead, bar_no, prev
from quantloom.sources.bars import resample

LEVEL = ("symbol", "price", "touches", "kind", "timeframe", "source", "label")


def swings(bars: DataFrame, reach: int = 3) -> DataFrame:
    """Adds swing_high, swing_low and their prices, on the bar that confirms them: ``reach`` bars after the extreme.

    The extreme must be as high (low) as every bar within ``reach`` on both sides; ties qualify.
    """
    span = ahead(-2 * reach, 0)
    ready = bar_no() > 2 * reach
    high, low = prev("high", reach), prev("low", reach)
    out = bars.withColumns({
        "swing_high": F.coalesce(ready & (high >= F.max("high").over(span)), F.lit(False)),
        "swing_low": F.coalesce(ready & (low <= F.min("low").over(span)), F.lit(False)),
        "_h": high,
        "_l": low,
    })
    return out.withColumns({"swing_high_price": F.when(F.col("swing_high"), F.col("_h")), "swing_low_price": F.when(F.col("swing_low"), F.col("_l"))}).drop("_h", "_l")


def cluster_prices(prices: DataFrame, tolerance: float, by: tuple[str, ...] = ("symbol", "kind")) -> DataFrame:
    """(by, price, touches): sorted prices chained while each is within ``tolerance`` of the one before; means and sizes."""
    w = Window.partitionBy(*by).orderBy("price")
    step = F.col("price") - F.lag("price").over(w)
    marked = prices.where("price IS NOT NULL AND NOT isnan(price)").withColumn("_new", F.coalesce((step > tolerance * F.abs(F.lag("price").over(w))).cast("int"), F.lit(1)))
    # The default frame ends with the last equal price, so equal prices never part.
    numbered = marked.withColumn("_cluster", F.sum("_new").over(w))
    return numbered.groupBy(*by, "_cluster").agg(F.avg("price").alias("price"), F.count(F.lit(1)).cast("int").alias("touches")).drop("_cluster")


def swing_levels(bars: DataFrame, reach: int = 3, tolerance: float = 0.003, min_touches: int = 2, timeframe: str = "main") -> DataFrame:
    """Level rows of clustered swing prices met ``min_touches`` times or more."""
    both = swings(bars, reach).select("symbol", F.explode(F.array(
        F.struct(F.lit("resistance").alias("kind"), F.col("swing_high_price").alias("price")),
        F.struct(F.lit("support").alias("kind"), F.col("swing_low_price").alias("price")),
    )).alias("p"))
    found = cluster_prices(both.select("symbol", "p.kind", "p.price"), tolerance).where(F.col("touches") >= min_touches)
    return found.withColumns({"timeframe": F.lit(timeframe), "source": F.lit("swing"), "label": F.lit("")}).select(*LEVEL)


def higher_levels(bars: DataFrame, rule: str = "4 hours", label: str = "4H", **options) -> DataFrame:
    """Swing levels of the bars resampled to ``rule``."""
    return swing_levels(resample(bars, rule, label), timeframe=label, **options)


def daily_pivots(bars: DataFrame, last_days: int = 3) -> DataFrame:
    """P, R1, S1, R2 and S2 of each series' last days, the open day among them."""
    days = resample(bars, "1 day", "1d")
    recent = days.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_dt")))).where(F.col("_n") <= last_days)
    h, low, p = F.col("high"), F.col("low"), (F.col("high") + F.col("low") + F.col("close")) / 3
    levels = {"P": p, "R1": 2 * p - low, "S1": 2 * p - h, "R2": p + (h - low), "S2": p - (h - low)}
    rows = recent.select("symbol", "open_dt", F.inline(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("price")) for k, v in levels.items()])))
    return rows.withColumns({"touches": F.lit(1), "kind": F.lit("pivot"), "timeframe": F.lit("1D"), "source": F.lit("pivot")}).select(*LEVEL, "open_dt")


def level_report(bars: DataFrame, reach: int = 3, tolerance: float = 0.003, min_touches: int = 3, pivots: bool = True, higher: tuple[str, str] | None = ("4 hours", "4H")) -> DataFrame:
    """Swing levels, daily pivots and higher-timeframe levels in one table."""
    out = swing_levels(bars, reach, tolerance, min_touches)
    if pivots:
        out = out.unionByName(daily_pivots(bars).drop("open_dt"))
    if higher:
        out = out.unionByName(higher_levels(bars, *higher, reach=reach, tolerance=tolerance, min_touches=min_touches))
    return out


def equity(trades: DataFrame, pnl: str = "pnl", order: tuple[str, ...] = ("entry_dt", "signal_dt")) -> DataFrame:
    """Adds equity (starts at 100, compounded) to each series' trades in order."""
    w = Window.partitionBy(*KEYS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("equity", 100 * F.product(1 + F.col(pnl)).over(w))


