"""Streak and pattern studies: next-bar odds, bins, heat maps, distributions over days, pullbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import binomial_p, bonferroni, floored, is_floored, reliability, wilson
from quantloom.functions.windows import KEYS, prev, roll, yes, series

# Bin edges and thresholds of the studies.
RSI_BINS = (0, 30, 40, 50, 60, 70, 80, 100)
DISPARITY_BINS = (0, 90, 95, 100, 105, 110, 120, 200)
RETRACEMENT_BINS = (0, 20, 30, 40, 50, 60, 70, 80, 100)
ATR_BINS = (0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 100.0)
RSI_OVERBOUGHT = 80


def with_odds(df: DataFrame, k: str = "k", n: str = "n", tests: int = 1) -> DataFrame:
    """Adds rate, Wilson bounds, exact p and whether it was floored, reliability and whether p passes the level corrected for ``tests`` tests."""
    low, high = wilson(F.col(k), F.col(n))
    out = df.withColumns({"rate": F.when(F.col(n) > 0, F.col(k) / F.col(n) * 100), "ci_lower": low, "ci_upper": high, "_p": binomial_p(F.col(k), F.col(n)), "reliability": reliability(F.col(n))})
    out = out.withColumns({"p_value": floored(F.col("_p")), "p_floored": is_floored(F.col("_p"))}).drop("_p")
    return out.withColumn("significant", F.col("p_value") < bonferroni(F.lit(tests)))


def next_bars(bars: DataFrame) -> DataFrame:
    """Adds c1_green, c2_green and c1_ret (percent): colours of the next two bars and the next bar's return."""
    green = F.col("close") > F.col("open")
    ret = F.when(F.col("close") != 0, (F.lead("close").over(series()) / F.col("close") - 1) * 100)
    return bars.withColumns({"c1_green": F.lead(green).over(series()), "c2_green": F.lead(green, 2).over(series()), "c1_ret": ret})


def streak_odds(bars: DataFrame, matched: str = "matched") -> DataFrame:
    """Per series, zero counts included: cases, cases with a next bar, those green, with bounds and p."""
    out = next_bars(bars)
    on = yes(F.col(matched))
    counts = out.groupBy(*KEYS).agg(
        F.count_if(on).alias("cases"),
        F.count_if(on & F.col("c1_green").isNotNull()).alias("n"),
        F.count_if(on & yes(F.col("c1_green"))).alias("k"),
        F.count_if(on & yes(F.col("c1_green")) & F.col("c2_green").isNotNull()).alias("n_c2_after_green"),
        F.count_if(on & yes(F.col("c1_green")) & yes(F.col("c2_green"))).alias("k_c2_after_green"),
        F.count_if(on & ~F.coalesce("c1_green", F.lit(True)) & F.col("c2_green").isNotNull()).alias("n_c2_after_red"),
        F.count_if(on & ~F.coalesce("c1_green", F.lit(True)) & yes(F.col("c2_green"))).alias("k_c2_after_red"),
        F.avg(F.when(on, F.col("c1_ret"))).alias("c1_ret"),
    )
    return with_odds(counts)


def bin_no(value: Column, edges: tuple[float, ...], closed: str = "right", lowest: bool = False) -> Column:
    """Number (from 0) of the bin of ``value``; null outside all.

    ``right``: (a, b], with ``lowest`` the first is closed.  ``left``: [a, b), the last is closed.
    """
    out, last = None, len(edges) - 2
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if closed == "right":
            inside = ((value >= a) if lowest and i == 0 else (value > a)) & (value <= b)
        else:
            inside = (value >= a) & ((value <= b) if i == last else (value < b))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def bin_label(number: Column, edges: tuple[float, ...]) -> Column:
    labels = [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)]
    return F.get(F.array(*map(F.lit, labels)), number)


def binned_odds(df: DataFrame, value: str, target: str, edges: tuple[float, ...]) -> DataFrame:
    """Per series and bin that has rows: n, k (target true), bounds and p; significance corrected for all bins."""
    rows = df.select(*KEYS, bin_no(F.col(value), edges).alias("bin_no"), yes(F.col(target)).alias("_t")).where("bin_no IS NOT NULL")
    counts = rows.groupBy(*KEYS, "bin_no").agg(F.count(F.lit(1)).alias("n"), F.count_if("_t").alias("k"))
    return with_odds(counts, tests=len(edges) - 1).withColumn("bin", bin_label(F.col("bin_no"), edges))


def heat_map(df: DataFrame, x: str, y: str, target: str, x_edges: tuple[float, ...], y_edges: tuple[float, ...]) -> DataFrame:
    """Per series and cell, empty ones included: n and k with bounds; first bins are closed below."""
    rows = df.select(*KEYS, bin_no(F.col(x), x_edges, lowest=True).alias("x_bin"), bin_no(F.col(y), y_edges, lowest=True).alias("y_bin"), yes(F.col(target)).alias("_t"))
    counts = rows.where("x_bin IS NOT NULL AND y_bin IS NOT NULL").groupBy(*KEYS, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("_t").alias("k"))
    series = df.select(*KEYS).distinct()
    cells = series.withColumn("x_bin", F.explode(F.sequence(F.lit(0), F.lit(len(x_edges) - 2)))).withColumn("y_bin", F.explode(F.sequence(F.lit(0), F.lit(len(y_edges) - 2))))
    full = cells.join(counts, [*KEYS, "x_bin", "y_bin"], "left").fillna(0, ["n", "k"])
    return with_odds(full, tests=(len(x_edges) - 1) * (len(y_edges) - 1))


def bin_stats(df: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """Per series and left-closed bin: count, mean, median, sample deviation, least and largest value."""
    v = F.col(value)
    rows = df.select(*KEYS, v.alias("_v"), bin_no(v, edges, "left").alias("bin_no")).where("bin_no IS NOT NULL")
    return rows.groupBy(*KEYS, "bin_no").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.percentile("_v", 0.5).alias("median"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )


def trimmed(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, deviation, least and largest of ``value`` without one smallest and one largest, where there are three or more."""
    keys, v = list(by or KEYS), F.col(value)
    rows = df.where(v.isNotNull()).select(*keys, v.cast("double").alias("v"))
    w = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_low": F.row_number().over(w.orderBy("v")), "_high": F.row_number().over(w.orderBy(F.desc("v")))})
    kept = ranked.where((F.col("_n") < 3) | ((F.col("_low") > 1) & (F.col("_low") < F.col("_n"))))
    return kept.groupBy(*keys).agg(F.max("_n").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), (F.max("_n") >= 3).alias("trimmed"))


def reversal_report(bars: DataFrame, n: int = 3, direction: str = "green") -> DataFrame:
    """Per series: bars after n bars of one colour and one of the other; how many resume, and the bar before's figures.

    Needs is_green, rsi_sma, body_pct and vol_change; figures come from the bar before in the full series.
    """
    want = direction == "green"
    green = F.col("is_green").cast("int")
    out = bars.withColumns({"_run": F.sum(green).over(series().rowsBetween(-(n + 1), -2)), "_have": F.count(F.lit(1)).over(series().rowsBetween(-(n + 1), -2)), "_last": prev("is_green")})
    out = out.withColumns({f"prev_{c}": prev(c) for c in ("rsi_sma", "body_pct", "vol_change")})
    hit = (F.col("_have") == n) & (F.col("_run") == (n if want else 0)) & (F.col("_last") == (not want))
    good = F.col("is_green") == want
    out = out.where(yes(hit)).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"),
        *[F.avg(F.when(good if s == "success" else ~good, F.col(f"prev_{c}"))).alias(f"{s}_{c}") for s in ("success", "failure") for c in ("rsi_sma", "body_pct", "vol_change")],
    )
    return out.withColumn("success_rate", F.col("success") / F.col("total") * 100)


def short_fill(bars: DataFrame, n: int = 3, overbought: float = RSI_OVERBOUGHT, min_signals: int = 3) -> DataFrame:
    """Per series: shorts of the complex study, after n green bars with a high RSI, entered where the next bar rises by part of its usual rise.

    The entry is the open raised by max(0.1, 0.6 m) percent, m the mean rise (high over open) of all such bars; filled
    if the high gets there, won if the close is below it.  Series with fewer than ``min_signals`` have no row.
    """
    run = F.sum(F.col("is_green").cast("int")).over(series().rowsBetween(-n, -1)) == n
    out = bars.withColumns({"_run": run, "_rsi": prev("rsi_sma"), "_rise": F.when(F.col("open") != 0, (F.col("high") / F.col("open") - 1) * 100)})
    hits = out.where(yes(F.col("_run")) & yes(F.col("_rsi") >= overbought))
    mean = hits.groupBy(*KEYS).agg(F.avg("_rise").alias("_mean"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_signals)
    rows = hits.join(mean, KEYS).withColumn("rise", F.greatest(F.lit(0.1), 0.6 * F.coalesce("_mean", F.lit(0.5))))
    rows = rows.withColumn("_entry", F.col("open") * (1 + F.col("rise") / 100)).withColumn("_filled", F.col("high") >= F.col("_entry"))
    won = F.col("_filled") & (F.col("close") < F.col("_entry"))
    gain = F.when(won, (F.col("_entry") - F.col("close")) / F.col("_entry") * 100)
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("signals"), F.count_if("_filled").alias("filled"), F.count_if(won).alias("won"), F.max("rise").alias("entry_rise"), F.coalesce(F.avg(gain), F.lit(0.0)).alias("avg_profit")
    )


def pullback_quality(bars: DataFrame, matched: str, rise: int = 3, drop: int = 2) -> DataFrame:
    """Matched bars with retracement (percent) and vol_ratio of the rise + drop bars that end there.

    If the first of them is green, ``rise`` bars up come first and then ``drop`` bars down; else the other way round.
    """
    n = rise + drop
    out = bars.withColumn("_seg", F.collect_list(F.struct("open", "high", "low", "close", "volume")).over(roll(n)))
    out = out.where(yes(F.col(matched)) & (F.size("_seg") == n))
    seg = F.col("_seg")
    first = F.get(seg, F.lit(0))
    up_first = first["close"] > first["open"]

    def part(start: int, length: int) -> Column:
        return F.slice(seg, F.lit(start), F.lit(length))

    def mean(a: Column, length: int) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["volume"]) / length

    high = F.array_max(F.transform(part(1, rise), lambda x: x["high"]))
    low = F.array_min(F.transform(part(1, drop), lambda x: x["low"]))
    close, start = F.col("close"), first["open"]
    up = F.least(F.lit(100.0), F.when(high > start, (high - close) / (high - start) * 100).otherwise(0.0))
    down = F.least(F.lit(200.0), F.when(start > low, (close - low) / (start - low) * 100).otherwise(0.0))
    up_ratio = F.when(mean(part(1, rise), rise) > 0, mean(part(rise + 1, drop), drop) / mean(part(1, rise), rise)).otherwise(1.0)
    down_ratio = F.when(mean(part(1, drop), drop) > 0, mean(part(drop + 1, rise), rise) / mean(part(1, drop), drop)).otherwise(1.0)
    return out.withColumns({"retracement": F.when(up_first, up).otherwise(down), "vol_ratio": F.when(up_first, up_ratio).otherwise(down_ratio)}).drop("_seg")


def signal_score(df: DataFrame, rsi: str = "rsi_sma") -> DataFrame:
    """Adds score (0..100) and confidence from retracement, vol_ratio and RSI (50 where unknown); the bounds are fixed values."""
    r, v, s = F.col("retracement"), F.col("vol_ratio"), F.coalesce(F.col(rsi), F.lit(50.0))
    score = (
        F.when(r < 30, 40).when(r < 50, 30).when(r < 70, 15).otherwise(0)
        + F.when(v < 0.7, 30).when(v < 1.0, 20).when(v < 1.5, 10).otherwise(0)
        + F.when(s > 70, 30).when(s > 65, 25).when(s > 60, 15).otherwise(0)
    )
    out = df.withColumn("score", score)
    return out.withColumn("confidence", F.when(F.col("score") >= 80, "high").when(F.col("score") >= 60, "medium").otherwise("low"))


def _extremes(bars: DataFrame, period: Column) -> DataFrame:
    """Per series and period: times of the first lowest and first highest bar, and mean range in percent of the open."""
    span = F.when(F.col("open") > 0, (F.col("high") - F.col("low")) / F.col("open") * 100)
    return bars.groupBy(*KEYS, period.alias("period")).agg(
        F.min_by("open_dt", F.struct("low", "open_dt")).alias("low_dt"), F.min_by("open_dt", F.struct(-F.col("high"), F.col("open_dt"))).alias("high_dt"), F.avg(span).alias("range_pct"), F.count(F.lit(1)).alias("n")
    )


def intraday_extremes(bars: DataFrame, zone: str = "America/New_York", hours: int = 4) -> DataFrame:
    """Per series and part of the local day: days (UTC) whose low and whose high falls there.

    Days whose low and high share a part are left out; n_days counts the others, all_days all.
    """
    days = _extremes(bars, F.to_date("open_dt"))
    part = lambda c: F.floor(F.hour(F.from_utc_timestamp(F.col(c).cast("timestamp"), zone)) / hours).cast("int")
    days = days.withColumns({"_l": part("low_dt"), "_h": part("high_dt")}).withColumn("_ok", F.col("_l") != F.col("_h"))
    totals = days.groupBy(*KEYS).agg(F.count_if("_ok").alias("n_days"), F.count(F.lit(1)).alias("all_days"), F.avg("range_pct").alias("range_pct"), *[
        F.count_if(F.col("_ok") & (F.col(c) == p)).alias(f"{c}{p}") for c in ("_l", "_h") for p in range(24 // hours)
    ])
    cells = F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"_l{p}").alias("lows"), F.col(f"_h{p}").alias("highs")) for p in range(24 // hours)]))
    return totals.select(*KEYS, "n_days", "all_days", "range_pct", cells)


def weekday_extremes(bars: DataFrame, min_rows: int = 3) -> DataFrame:
    """Per series and weekday (0 Monday): weeks whose low and whose high falls on it, of weeks with enough bars."""
    weeks = _extremes(bars, F.date_trunc("week", "open_dt").cast("date")).where(F.col("n") >= min_rows)
    both = weeks.select(*KEYS, F.explode(F.array(F.struct(F.weekday("low_dt").alias("d"), F.lit(1).alias("l"), F.lit(0).alias("h")), F.struct(F.weekday("high_dt").alias("d"), F.lit(0).alias("l"), F.lit(1).alias("h")))).alias("x"))
    return both.groupBy(*KEYS, F.col("x.d").alias("weekday")).agg(F.sum("x.l").alias("lows"), F.sum("x.h").alias("highs"))


def with_swings(bars: DataFrame) -> DataFrame:
    """Adds dip and rise: how far low and high are from the open, in percent of it."""
    o = F.when(F.col("open") != 0, F.col("open"))
    return bars.withColumns({"dip": (o - F.col("low")) / o * 100, "rise": (F.col("high") - o) / o * 100})


def dip_score(bars: DataFrame, matched: str) -> DataFrame:
    """Per series: z-score of the latest matched bar's dip by the trimmed mean and deviation of all, to two places, and its label."""
    rows = with_swings(bars.where(yes(F.col(matched))))
    usual = trimmed(rows, "dip").select(*KEYS, "mean", "std")
    z = F.round(F.when(F.col("std") > 0, (F.col("dip") - F.col("mean")) / F.col("std")), 2)
    out = rows.groupBy(*KEYS).agg(F.max_by("dip", "open_dt").alias("dip")).join(usual, KEYS).select(*KEYS, z.alias("z"))
    return out.withColumn("label", F.when(F.abs("z") < 1, "normal").when(F.abs("z") < 2, "unusual").when(F.col("z").isNotNull(), "extreme"))


def volatility(bars: DataFrame, matched: str) -> DataFrame:
    """Per series, of the bars after matched ones: trimmed mean and deviation of the dip, mean rise, mean atr_pct, worst dips."""
    after = with_swings(bars.withColumn("_after", prev(matched))).where(yes(F.col("_after")))
    dips, rises = trimmed(after, "dip"), trimmed(after, "rise")
    all_ = after.groupBy(*KEYS).agg(F.avg("atr_pct").alias("avg_atr_pct"), F.max("dip").alias("extreme_dip"), F.count(F.lit(1)).alias("n"))
    out = dips.select(*KEYS, F.col("mean").alias("avg_dip"), F.col("std").alias("std_dip"), F.col("max").alias("practical_dip"), "trimmed")
    return out.join(rises.select(*KEYS, F.col("mean").alias("avg_rise")), KEYS).join(all_, KEYS)


def short_signal(bars: DataFrame, n: int = 3, overbought: float = RSI_OVERBOUGHT, min_signals: int = 3) -> DataFrame:
    """Per series: shorts of the simple study, entered where a bar rises by part of the usual rise of all matched bars.

    Matched bars end n green ones; a signal is a bar after n green ones and a high RSI.  The entry is the open raised by
    max(0.1, 0.6 m) percent, m the trimmed mean rise of the matched bars (0.5 if there is none).  Series with fewer than
    ``min_signals`` signals or without a filled one have no row.
    """
    green = F.col("is_green").cast("int")
    out = with_swings(bars).withColumns({"_match": F.sum(green).over(roll(n)) == n, "_run": F.sum(green).over(series().rowsBetween(-n, -1)) == n, "_rsi": prev("rsi_sma")})
    usual = trimmed(out.where(yes(F.col("_match"))), "rise").select(*KEYS, F.col("mean").alias("_mean"))
    rows = out.where(yes(F.col("_run")) & yes(F.col("_rsi") >= overbought)).join(usual, KEYS, "left")
    rows = rows.withColumn("entry_rise", F.greatest(F.lit(0.1), 0.6 * F.coalesce("_mean", F.lit(0.5))))
    rows = rows.withColumn("_entry", F.col("open") * (1 + F.col("entry_rise") / 100)).withColumn("_filled", F.col("high") >= F.col("_entry"))
    won = F.col("_filled") & (F.col("close") < F.col("_entry"))
    gain = F.when(won, (F.col("_entry") - F.col("close")) / F.col("_entry") * 100)
    sums = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("signals"), F.count_if("_filled").alias("filled"), F.count_if(won).alias("won"), F.max("entry_rise").alias("entry_rise"), F.coalesce(F.avg(gain), F.lit(0.0)).alias("avg_profit"))
    sums = sums.where((F.col("signals") >= min_signals) & (F.col("filled") > 0))
    fill = F.col("filled") / F.col("signals") * 100
    sums = sums.withColumns({"fill_rate": fill, "win_rate": F.col("won") / F.col("filled") * 100, "overall_win_rate": F.col("won") / F.col("signals") * 100})
    # The bounds of the labels.
    return sums.withColumns({
        "reliability": F.when(F.col("fill_rate") >= 70, "high").when(F.col("fill_rate") >= 50, "medium").otherwise("low"),
        "bias_warning": F.col("fill_rate") < 50, "enabled": (F.col("win_rate") >= 60) & (F.col("fill_rate") >= 50),
    })


def stops_from_means(df: DataFrame, up: str, down: str, k_stop: float = 1.5, k_target: float = 2.0) -> DataFrame:
    """Adds stop_pct and target_pct: multiples of the mean fall and of the mean rise, both in percent."""
    return df.withColumns({"stop_pct": k_stop * F.abs(F.col(down)), "target_pct": k_target * F.col(up)})
