"""Sweeps over the parameters of signals: every strategy and parameter set in one job.

A series gets prefix sums and a sparse table of extremes once; a mean, deviation or channel of any length is then two
lookups (``lag`` in the one window of the series) instead of a window of that length.  Exponential means of all lengths
share one block scan.  Parameter sets stay rows: a bar turns into one row for each set whose signal it has, and each such
event meets its own stop, target and time-out by first passage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import scan
from quantloom.functions.windows import KEYS, bar_no, prev, series, share, yes
from quantloom.operators.passage import first_passage
from quantloom.operators.sweep import trade_figures

#: Bars over which prefix sums run before they start again, so that differences lose few digits; no length is longer.
SEGMENT = 4096
#: What a set holds where it does not say: the usual values.
USUAL = {
    "take_profit": 4.0, "stop_loss": 2.0, "max_hold": 6, "fast_len": 20, "slow_len": 60, "rsi_level": 70, "adx_level": 25, "band_len": 20, "band_width": 2.0,
    "atr_len": 20, "keltner_width": 1.5, "volume_factor": 2.0, "volume_len": 20, "channel_len": 20, "macd_fast": 12, "macd_slow": 26, "macd_signal": 9,
}
STRATEGIES = ("ma_cross", "band_breakout", "mean_reversion", "squeeze", "trend", "turtle")


class Lookups:
    """Means, deviations and extremes of any length over a series' columns, each made of what two bars hold."""

    def __init__(self, bars: DataFrame, columns: Sequence[str], longest: int) -> None:
        if longest > SEGMENT:
            raise ValueError(f"lengths above {SEGMENT} bars are not swept: {longest}")
        out = bars.withColumn("bar_no", bar_no()).withColumn("_seg", F.floor((F.col("bar_no") - 1) / SEGMENT))
        inside = Window.partitionBy(*KEYS, "_seg").orderBy("open_dt").rowsBetween(Window.unboundedPreceding, 0)
        for c in columns:
            base = F.first(c, ignorenulls=True).over(Window.partitionBy(*KEYS).orderBy("open_dt").rowsBetween(Window.unboundedPreceding, 0))
            out = out.withColumn(f"_d_{c}", F.col(c) - base)  # squares of what is far from 0 lose digits
        self._sums = {f"_{k}_{c}": e for c in columns for k, e in (("s", F.col(c)), ("o", F.col(f"_d_{c}")), ("q", F.col(f"_d_{c}") ** 2), ("n", F.col(c).isNotNull().cast("long")))}
        out = out.withColumns({k: F.sum(e).over(inside) for k, e in self._sums.items()})
        out = out.withColumns({f"{k}_all": F.sum(e).over(Window.partitionBy(*KEYS, "_seg")) for k, e in self._sums.items()})
        self.bars, self._levels = out, {}

    def _total(self, kind: str, c: str, n: int) -> Column:
        """The sum over the last n bars: two prefix sums, and a segment's whole where they lie in neighbours."""
        here, w = F.col(f"_{kind}_{c}"), series()
        before = F.coalesce(F.lag(here, n).over(w), F.lit(0))
        rest = F.when(F.lag("_seg", n).over(w) != F.col("_seg"), F.lag(f"_{kind}_{c}_all", n).over(w)).otherwise(F.lit(0))
        return here + (rest - before)

    def _full(self, c: str, n: int) -> Column:
        return (F.col("bar_no") >= n) & (self._total("n", c, n) == n)

    def mean(self, c: str, n: int) -> Column:
        return F.when(self._full(c, n), self._total("s", c, n) / n)

    def deviation(self, c: str, n: int) -> Column:
        """Sample deviation."""
        total, squares = self._total("o", c, n), self._total("q", c, n)
        return F.when(self._full(c, n), F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1)))

    def greatest(self, c: str, n: int) -> Column:
        """The greatest of the last n bars: two runs of a power of two that cover them."""
        level = n.bit_length() - 1
        for k in range(len(self._levels.setdefault(c, [c])), level + 1):
            last = self._levels[c][-1]
            name = f"_top{k}_{c}"
            self.bars = self.bars.withColumn(name, F.greatest(F.col(last), F.lag(last, 1 << k - 1).over(series())))
            self._levels[c].append(name)
        top = F.col(self._levels[c][level])
        return F.when(F.col("bar_no") >= n, F.greatest(top, F.lag(top, n - (1 << level)).over(series())) if n > 1 << level else top)


def _signal(p: Mapping) -> Column:
    """The signal of one set over the columns that ``frame`` made."""
    mean, close = lambda n: F.col(f"_mean_{n}"), F.col("close")
    middle, width = mean(p["band_len"]), F.col(f"_dev_{p['band_len']}")
    upper, lower = middle + float(p["band_width"]) * width, middle - float(p["band_width"]) * width
    match p["strategy"]:
        case "ma_cross":
            fast, slow = f"_mean_{p['fast_len']}", f"_mean_{p['slow_len']}"
            return (F.col(fast) > F.col(slow)) & (prev(fast) <= prev(slow))
        case "band_breakout":
            before = prev(f"_mean_{p['band_len']}") + float(p["band_width"]) * prev(f"_dev_{p['band_len']}")
            return (close > upper) & (prev("close") <= before) & (F.col("volume") > float(p["volume_factor"]) * F.col(f"_vol_{p['volume_len']}"))
        case "mean_reversion":
            return (close > mean(p["slow_len"])) & (close < lower) & (F.col("rsi_14") < 100 - p["rsi_level"])
        case "squeeze":
            room = float(p["keltner_width"]) * F.col(f"atr_{p['atr_len']}")
            on = yes((upper < middle + room) & (lower > middle - room))
            return F.lag(on).over(series()) & ~on & (close > middle)
        case "trend":
            line = F.col(f"ema_{p['macd_fast']}") - F.col(f"ema_{p['macd_slow']}")
            return (F.col("adx_14") >= p["adx_level"]) & (close > mean(p["fast_len"])) & (line > F.col(f"signal_{p['macd_fast']}_{p['macd_slow']}_{p['macd_signal']}"))
        case "turtle":
            return (close > prev(f"_top_{p['channel_len']}")) & (close > mean(p["slow_len"]))
    raise ValueError(f"unknown strategy: {p['strategy']}")


def frame(bars: DataFrame, sets: Sequence[Mapping]) -> DataFrame:
    """``bars`` with bar_no and every column that a signal of ``sets`` reads, each length once."""
    of = lambda name, *which: sorted({int(s[name]) for s in sets if s["strategy"] in which})
    names = [f"ema_{n}" for n in sorted({*of("macd_fast", "trend"), *of("macd_slow", "trend")})] + [f"atr_{n}" for n in of("atr_len", "squeeze")]
    names += ["rsi_14"] * bool(of("rsi_level", "mean_reversion")) + ["adx_14"] * bool(of("adx_level", "trend"))
    names += [f"signal_{a}_{b}_{c}" for a, b, c in sorted({(int(s["macd_fast"]), int(s["macd_slow"]), int(s["macd_signal"])) for s in sets if s["strategy"] == "trend"})]
    out = scan.recursive(bars, names) if names else bars
    banded = of("band_len", "band_breakout", "mean_reversion", "squeeze")
    means = sorted({*of("fast_len", "ma_cross", "trend"), *of("slow_len", "ma_cross", "mean_reversion", "turtle"), *banded})
    volumes, channels = of("volume_len", "band_breakout"), of("channel_len", "turtle")
    look = Lookups(out, ["close", *(["volume"] if volumes else [])], max([1, *means, *volumes, *channels]))
    columns = {f"_mean_{n}": look.mean("close", n) for n in means} | {f"_dev_{n}": look.deviation("close", n) for n in banded} | {f"_vol_{n}": look.mean("volume", n) for n in volumes}
    columns |= {f"_top_{n}": look.greatest("high", n) for n in channels}
    return look.bars.withColumns(columns)


def evaluate(bars: DataFrame, sets: Sequence[Mapping], train: float = 0.7) -> DataFrame:
    """(series, param_id, split, n_trades, win_rate, total_pnl, avg_pnl) of close-entry long trades of every set.

    A set names its ``strategy`` and what differs from ``USUAL``; its number is its place.  ``split`` is train, test or
    full; trades whose time-out lies past their split's end are left out of the split.
    """
    sets = [dict(USUAL) | dict(s) for s in sets]
    own = frame(bars, sets)
    rows = [
        F.struct(F.lit(i).alias("param_id"), F.lit(float(s["take_profit"])).alias("take_profit"), F.lit(float(s["stop_loss"])).alias("stop_loss"), F.lit(int(s["max_hold"])).alias("max_hold"), F.col(f"_on_{i}").alias("on"))
        for i, s in enumerate(sets)
    ]
    own = own.withColumns({f"_on_{i}": yes(_signal(s)) for i, s in enumerate(sets)}).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))
    events = own.select(*KEYS, "bar_no", "_n", F.col("close").alias("entry_price"), F.inline(F.filter(F.array(*rows), lambda r: r["on"]))).drop("on")
    events = events.withColumns({"_from": F.col("bar_no") + 1, "_to": F.col("bar_no") + F.col("max_hold")}).where("_to <= _n")
    e = F.col("entry_price")
    stop, target = e * (1 - F.col("stop_loss") / 100), e * (1 + F.col("take_profit") / 100)
    plain = bars.select(*KEYS, "open_dt", "high", "low", "close").withColumn("bar_no", bar_no())
    found = first_passage(events, plain, max(int(s["max_hold"]) for s in sets), stop, target, ["high", "low", "close"])
    price = F.when(F.col("f_low") <= stop, stop).when(F.col("f_high") >= target, target).otherwise(F.col("f_close"))
    cut = share(F.col("_n"), train)
    split = F.when(F.col("bar_no") > cut, "test").when(F.col("_to") <= cut, "train")
    trials = found.select(*KEYS, "param_id", ((price - e) / e * 100).alias("pnl"), F.explode(F.array_compact(F.array(split, F.lit("full")))).alias("split"))
    return trials.groupBy(*KEYS, "param_id", "split").agg(*trade_figures())
