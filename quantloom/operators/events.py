"""Event studies: what happens in the bars after a signal.

Forward frames carry the horizon, so no join is made; signals are filtered only after their frame was computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import KEYS, ahead, following, yes, series
from quantloom.operators.patterns import DIRECTIONS
from quantloom.operators.signals import crosses_above, crosses_below, first_of_run


def event_mask(side: str = "lower", regime: str | None = None) -> Column:
    """Touch of the lower or upper band, above or below the 200-bar mean if asked for."""
    touch = F.col(f"touch_{side}")
    if regime:
        touch = touch & (F.col("close") > F.col("sma_200") if regime == "above_sma200" else F.col("close") < F.col("sma_200"))
    return yes(touch)


def first_touches(bars: DataFrame, side: str = "lower", regime: str | None = None) -> DataFrame:
    """Adds event: the first bar of each run of bars in the mask."""
    out = bars.withColumn("_mask", event_mask(side, regime))
    return out.withColumn("event", first_of_run("_mask")).drop("_mask")


def band_filter(bars: DataFrame, mode: str = "lower_touch", horizon: int = 7) -> DataFrame:
    """Adds bb_filter.  ``mid_reversion`` looks ahead: a first touch of either band that the middle follows."""
    if mode in ("lower_touch", "upper_touch"):
        return first_touches(bars, mode.partition("_")[0]).withColumnRenamed("event", "bb_filter")
    out = bars.withColumn("_either", F.col("touch_lower") | F.col("touch_upper")).withColumn("_first", first_of_run("_either"))
    later = F.max(F.col("touch_mid").cast("int")).over(ahead(1, horizon)) == 1
    return out.withColumn("bb_filter", yes(F.col("_first") & later)).drop("_either", "_first")


def mid_touch(bars: DataFrame, side: str = "lower", horizon: int = 7, regime: str | None = None, extra: int = 5) -> DataFrame:
    """Per series: events with a bar after them, those whose middle band is touched within ``horizon`` bars, the mean
    number of bars to it, and of the others with ``extra`` more bars, how many touch it exactly then (late_1..)."""
    out = first_touches(bars, side, regime)
    touched = F.array_position(F.collect_list(F.col("touch_mid").cast("int")).over(ahead(1, horizon)), F.lit(1))
    late = F.collect_list(F.col("touch_mid").cast("int")).over(ahead(horizon + 1, horizon + extra))
    out = out.withColumns({"_more": following("open_dt"), "_at": touched, "_late": late}).where(F.col("event") & F.col("_more").isNotNull())
    failed = (F.col("_at") == 0) & (F.size("_late") == extra)
    hit = F.array_position("_late", F.lit(1))
    return out.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("_at") > 0).alias("success"),
        F.avg(F.when(F.col("_at") > 0, F.col("_at"))).alias("mean_bars"),
        F.count_if(failed).alias("failed"),
        *[F.count_if(failed & (hit == k)).alias(f"late_{k}") for k in range(1, extra + 1)],
    )


def excursions(bars: DataFrame, horizon: int = 7) -> DataFrame:
    """Adds mfe, mae and end_ret: best, worst and last return in percent over the next bars, cut at the series' end."""
    w, close = ahead(1, horizon), F.col("close")
    pct = lambda x: F.when(close > 0, (x - close) / close * 100)
    return bars.withColumns({"mfe": pct(F.max("high").over(w)), "mae": pct(F.min("low").over(w)), "end_ret": pct(F.last("close").over(w))})


def quartile_reach(bars: DataFrame, side: str = "lower", horizon: int = 7, regime: str | None = None) -> DataFrame:
    """Per series: how far over the band (0 lower, 1 upper, in quarters) prices got after each event."""
    width = F.col("bb_up") - F.col("bb_low")
    price = F.col("high") if side == "lower" else F.col("low")
    place = F.when(width > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (price - F.col("bb_low")) / width)))
    best = F.max if side == "lower" else F.min
    out = first_touches(bars, side, regime).withColumn("_place", place)
    out = out.withColumn("_reach", best("_place").over(ahead(1, horizon))).where(F.col("event") & F.col("_reach").isNotNull())
    reach = F.col("_reach")
    return out.groupBy(*KEYS).agg(
        F.count_if(reach <= 0.25).alias("q1"),
        F.count_if((reach > 0.25) & (reach <= 0.5)).alias("q2"),
        F.count_if((reach > 0.5) & (reach <= 0.75)).alias("q3"),
        F.count_if(reach > 0.75).alias("q4"),
        F.count(F.lit(1)).alias("total"),
    )


def take_profit(bars: DataFrame, signal: str, target: float = 0.01, horizon: int = 5, direction: str = "long") -> DataFrame:
    """One row for each signal that can be entered at the next open: entry, hit and ret in percent.

    The target may be met on the entry bar or the ``horizon`` bars after it; else the last of these closes counts.
    """
    w, entry = ahead(1, horizon + 1), following("open")
    out = bars.withColumns({"entry": entry, "_high": F.max("high").over(w), "_low": F.min("low").over(w), "_last": F.last("close").over(w)})
    out = out.where(yes(F.col(signal)) & (F.col("entry") > 0))
    e = F.col("entry")
    if direction == "short":
        hit, rest = F.col("_low") <= e * (1 - target), (e - F.col("_last")) / e * 100
    else:
        hit, rest = F.col("_high") >= e * (1 + target), (F.col("_last") - e) / e * 100
    return out.withColumn("hit", hit).withColumn("ret", F.when(F.col("hit"), F.lit(target * 100)).otherwise(rest)).drop("_high", "_low", "_last")


def take_profit_summary(events: DataFrame) -> DataFrame:
    return events.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("hit").alias("tp_hits"), (F.count_if("hit") / F.count(F.lit(1)) * 100).alias("hit_rate"), F.avg("ret").alias("avg_ret")
    )


def pattern_hits(bars: DataFrame, names: list[str], horizon: int = 3, target: float = 0.01, mode: str = "natural", position: str = "long") -> DataFrame:
    """Per series and pattern: signals before the last bar, and the share whose target is met within ``horizon`` bars.

    ``natural`` takes each pattern's own direction; ``position`` the given one.  last_on tells whether the bar before
    the last has the pattern.
    """
    w, close = ahead(1, horizon), F.col("close")
    out = bars.withColumns({"_up": F.max("high").over(w), "_down": F.min("low").over(w), "_left": F.count(F.lit(1)).over(ahead(1, 2))})
    sides = {n: DIRECTIONS.get(n) if mode == "natural" else ("bull" if position == "long" else "bear") for n in names}
    rows = out.where("_left > 0").select(*KEYS, "_left", close.alias("_close"), "_up", "_down", F.inline(F.array(*[
        F.struct(F.lit(n).alias("pattern"), F.lit(sides[n]).alias("direction"), yes(F.col(n)).alias("on")) for n in names
    ])))
    gain = F.when(F.col("direction") == "bull", (F.col("_up") - F.col("_close")) / F.col("_close")).otherwise((F.col("_close") - F.col("_down")) / F.col("_close"))
    hit = F.avg(F.when(F.col("on"), (gain >= target).cast("double"))) * 100
    return rows.groupBy(*KEYS, "pattern", "direction").agg(F.count_if("on").alias("signals"), hit.alias("hit_rate"), F.bool_or(F.col("on") & (F.col("_left") == 1)).alias("last_on"))


def cross_touches(bars: DataFrame, fast: str, slow: str, higher: str, horizon: int = 10, kind: str = "golden") -> DataFrame:
    """Per series: crosses of two means, and how many of them see the higher-timeframe mean touched in the next bars."""
    cross = crosses_above(fast, slow) if kind == "golden" else crosses_below(fast, slow)
    touch = yes((F.col("low") <= F.col(higher)) & (F.col(higher) <= F.col("high")))
    out = bars.withColumns({"_cross": cross, "_touch": touch})
    out = out.withColumn("_met", F.max(F.col("_touch").cast("int")).over(ahead(1, horizon)))
    return out.where("_cross").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("crosses"), F.count_if(F.col("_met") == 1).alias("touched"))


def after_return(bars: DataFrame, signal: str, k: int = 5) -> DataFrame:
    """Per series: events, and mean return in percent over the k bars after those that have them."""
    ret = F.when(F.col("close") != 0, (F.lead("close", k).over(series()) / F.col("close") - 1) * 100)
    return bars.withColumn("_ret", ret).where(yes(F.col(signal))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events"), F.count("_ret").alias("complete"), F.avg("_ret").alias("avg_ret"))


def next_bar_probability(bars: DataFrame, condition: Column, target: Column) -> DataFrame:
    """Per series: bars that meet the condition and have a next bar, and how often that one meets the target."""
    out = bars.withColumns({"_on": yes(condition), "_next": F.lead(yes(target)).over(series())})
    return out.where(F.col("_on") & F.col("_next").isNotNull()).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if("_next").alias("k"))


