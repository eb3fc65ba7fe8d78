"""Rule back-tests and what is said about their trades."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import profit_factor, sharpe, sortino, t_statistic
from quantloom.functions.windows import KEYS, bar_no, share, yes
from quantloom.operators.passage import first_passage

TRADE = "symbol string, interval string, signal_dt timestamp_ntz, entry_dt timestamp_ntz, exit_dt timestamp_ntz, entry_price double, exit_price double, outcome string, direction string, regime string, pnl double"


@dataclass(frozen=True)
class Rules:
    """Parameters of a back-test; rates are fractions, ``exit_rule`` is fixed, connors or squeeze."""

    direction: str = "long"
    take_profit: float = 0.02
    stop_loss: float = 0.01
    max_bars: int = 48
    leverage: float = 10.0
    fee: float = 0.0004
    exit_rule: str = "fixed"

    def __post_init__(self) -> None:
        if self.direction not in ("long", "short") or self.exit_rule not in ("fixed", "connors", "squeeze"):
            raise ValueError(f"unknown direction or exit rule: {self.direction}, {self.exit_rule}")
        if not (self.take_profit > 0 and self.stop_loss > 0 and self.max_bars > 0 and 1 <= self.leverage <= 125 and self.fee >= 0):
            raise ValueError("parameters out of range")


def run(bars: DataFrame, signal: str, rules: Rules = Rules(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per trade.  A signal enters at the next bar's open, if that is not the last bar; trades may overlap.

    Each bar from the entry bar on is tried in this order: liquidation, the rule's own exit, stop, target; after
    ``max_bars`` more bars the close counts.  ``bars`` needs regime, and sma_20 or bb_mid for the exit rules; columns in
    ``keep`` identify runs beside the series (a split, a parameter set).
    """
    r, keys = rules, [*KEYS, *keep]
    w = Window.partitionBy(*keys).orderBy("open_dt")
    extra = {"connors": ["sma_20"], "squeeze": ["bb_mid"]}.get(r.exit_rule, [])
    own = bars.select(*keys, "open_dt", "open", "high", "low", "close", *extra, "regime", F.col(signal).alias("_signal"))
    own = own.withColumns({
        "bar_no": F.row_number().over(w),
        "entry_dt": F.lead("open_dt").over(w),
        "entry_price": F.lead("open").over(w),
        "entry_regime": F.lead("regime").over(w),
        "_two": F.lead("open_dt", 2).over(w),
    })
    own = own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    events = own.where(yes(F.col("_signal")) & F.col("_two").isNotNull()).select(
        *keys, "bar_no", F.col("open_dt").alias("signal_dt"), "entry_dt", "entry_price", F.col("entry_regime").alias("regime"),
        (F.col("bar_no") + 1).alias("_from"), F.least(F.col("bar_no") + r.max_bars + 1, F.col("_n")).alias("_to"),
    )
    sign = 1 if r.direction == "long" else -1
    e, c = F.col("entry_price"), F.col("f_close")
    liquidation, target, stop = e * (1 - sign / r.leverage), e * (1 + sign * r.take_profit), e * (1 - sign * r.stop_loss)
    against = (F.greatest if sign > 0 else F.least)(liquidation, stop)
    low, high = (against, target) if sign > 0 else (target, against)

    def leaves(close: Column, mean: Column) -> Column:
        over = (close > mean) == F.lit(sign > 0) if r.exit_rule == "connors" else (close < mean) == F.lit(sign > 0)
        return (close != mean) & over

    flag = leaves(F.col("close"), F.col(extra[0])) if extra else None
    found = first_passage(events, own, r.max_bars + 1, low, high, ["open_dt", "high", "low", "close", *extra], keys, flag)
    reaches = lambda level, up: F.col("f_high") >= level if up else F.col("f_low") <= level
    outcome = F.when(~F.col("met"), "TimeOut").when(reaches(liquidation, sign < 0), "Liquidation")
    if extra:
        outcome = outcome.when(leaves(c, F.col(f"f_{extra[0]}")), "Exit")
    outcome = outcome.when(reaches(stop, sign < 0), "SL").when(reaches(target, sign > 0), "TP")
    found = found.withColumn("_outcome", outcome)
    price = F.when(F.col("_outcome") == "Liquidation", liquidation).when(F.col("_outcome") == "SL", stop).when(F.col("_outcome") == "TP", target).otherwise(c)
    found = found.withColumn("x", F.struct(F.col("_outcome").alias("outcome"), price.alias("price"), F.col("f_open_dt").alias("dt")))
    pnl = F.when(F.col("x.outcome") == "Liquidation", F.lit(-1.0)).otherwise(sign * (F.col("x.price") - e) / e * r.leverage - 2 * r.fee * r.leverage)
    return found.select(
        *keys, "signal_dt", "entry_dt", F.col("x.dt").alias("exit_dt"), "entry_price", F.col("x.price").alias("exit_price"),
        F.col("x.outcome").alias("outcome"), F.lit(r.direction).alias("direction"), "regime", pnl.alias("pnl"),
    )


def run_at_close(bars: DataFrame, signal: str, take_profit: float = 2.0, stop_loss: float = 1.0, max_hold: int = 5) -> DataFrame:
    """Long trades entered at the signal's close, percentages; signals without ``max_hold`` bars after them are skipped."""
    own = bars.withColumns({"bar_no": bar_no(), "_n": F.count(F.lit(1)).over(Window.partitionBy(*KEYS))})
    events = own.where(yes(F.col(signal)) & (F.col("bar_no") <= F.col("_n") - max_hold)).select(
        *KEYS, "bar_no", F.col("open_dt").alias("entry_dt"), F.col("close").alias("entry_price"), (F.col("bar_no") + 1).alias("_from"), (F.col("bar_no") + max_hold).alias("_to")
    )
    e = F.col("entry_price")
    target, stop = e * (1 + take_profit / 100), e * (1 - stop_loss / 100)
    found = first_passage(events, own, max_hold, stop, target, ["open_dt", "high", "low", "close"])
    reason = F.when(F.col("met") & (F.col("f_low") <= stop), "SL").when(F.col("met") & (F.col("f_high") >= target), "TP").otherwise("Time")
    price = F.when(F.col("_reason") == "SL", stop).when(F.col("_reason") == "TP", target).otherwise(F.col("f_close"))
    found = found.withColumn("_reason", reason).withColumn("x", F.struct("offset", F.col("_reason").alias("reason"), price.alias("price"), F.col("f_open_dt").alias("dt")))
    pnl = (F.col("x.price") - e) / e * 100
    return found.select(*KEYS, "entry_dt", F.col("x.dt").alias("exit_dt"), "entry_price", F.col("x.price").alias("exit_price"), pnl.alias("pnl"), F.col("x.reason").alias("reason"), F.col("x.offset").alias("hold"), (pnl > 0).alias("is_win"))


def run_one_at_a_time(bars: DataFrame, take_profit: float, stop_loss: float, pullback: float, oversold: float = 30.0, uptrend: str = "uptrend", sharpes: DataFrame | None = None, least_sharpe: float = 0.0) -> DataFrame:
    """Long trades of which a series holds one at a time; each depends on when the last ended, so a fold carries it.

    Enters at the open of a green bar in an uptrend if the bar before fell by ``pullback`` percent and its RSI was
    oversold; stop (first) or target from the next bar on.  A trade still open at the end is dropped.  ``bars`` needs
    rsi_sma and the boolean ``uptrend``.  With ``sharpes`` (symbol, sharpe of a higher timeframe) only symbols whose ratio
    is above ``least_sharpe`` are traded.
    """
    if sharpes is not None:
        bars = bars.join(sharpes.where(F.col("sharpe") > least_sharpe).select("symbol"), "symbol", "left_semi")
    schema = "symbol string, interval string, entry_dt timestamp_ntz, exit_dt timestamp_ntz, entry_price double, exit_price double, pnl double, reason string"
    own = bars.select(*KEYS, "open_dt", "open", "high", "low", "close", "rsi_sma", yes(F.col(uptrend)).alias("_trend"))

    def fold(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("open_dt", kind="stable")
        o, h, low, c = (b[x].to_numpy(dtype=float) for x in ("open", "high", "low", "close"))
        rsi = b["rsi_sma"].to_numpy(dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            fell = (c / o - 1) * 100 <= -pullback
        ready = np.zeros(len(b), dtype=bool)
        ready[1:] = fell[:-1] & (rsi[:-1] < oversold) & (c[1:] > o[1:]) & b["_trend"].to_numpy()[1:]
        out, i = [], 0
        entries = np.flatnonzero(ready)
        while (at := np.searchsorted(entries, i)) < len(entries):
            start = int(entries[at])
            stop, target = o[start] * (1 - stop_loss / 100), o[start] * (1 + take_profit / 100)
            ends = np.flatnonzero((low[start + 1 :] <= stop) | (h[start + 1 :] >= target))
            if not len(ends):
                break
            end = start + 1 + int(ends[0])
            sl, tp = low[end] <= stop, h[end] >= target
            price = stop if sl else target
            out.append((b["symbol"].iloc[0], b["interval"].iloc[0], b["open_dt"].iloc[start], b["open_dt"].iloc[end], o[start], price, (price - o[start]) / o[start] * 100, "SL and TP" if sl and tp else "SL" if sl else "TP"))
            i = end + 1
        return pd.DataFrame(out, columns=["symbol", "interval", "entry_dt", "exit_dt", "entry_price", "exit_price", "pnl", "reason"])

    return own.groupBy(*KEYS).applyInPandas(fold, schema)


def summary(trades: DataFrame, *by: str) -> DataFrame:
    """Counts, win rate and PnL in percent, added and compounded, by the given columns (the series by default)."""
    n, pnl = F.count(F.lit(1)), F.col("pnl")
    return trades.groupBy(*(by or KEYS)).agg(
        n.alias("n_trades"),
        (F.count_if(pnl > 0) / n * 100).alias("win_rate"),
        (F.sum(pnl) * 100).alias("total_pnl"),
        (F.avg(pnl) * 100).alias("avg_pnl"),
        ((F.product(1 + pnl) - 1) * 100).alias("compounded_pnl"),
        F.count_if(F.col("outcome") == "Liquidation").alias("liq_count"),
    )


def drawdowns(trades: DataFrame, pnl: str = "pnl", order: str = "entry_dt", tie: str = "signal_dt") -> DataFrame:
    """Per series: largest fall of the added and of the compounded PnL from its peak so far, and longest run of losses."""
    w = Window.partitionBy(*KEYS).orderBy(order, tie)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    p = F.col(pnl)
    out = trades.withColumns({"_sum": F.sum(p).over(running), "_prod": F.product(1 + p).over(running), "_wins": F.sum((p >= 0).cast("int")).over(running)})
    out = out.withColumns({"_peak": F.max("_sum").over(running), "_top": F.max("_prod").over(running)})
    runs = out.groupBy(*KEYS, "_wins").agg(
        F.max(F.col("_peak") - F.col("_sum")).alias("_dd"), F.max("_peak").alias("_peak"), F.min(F.when(F.col("_top") != 0, (F.col("_prod") - F.col("_top")) / F.col("_top"))).alias("_cdd"), F.count_if(p < 0).alias("_losses")
    )
    return runs.groupBy(*KEYS).agg(
        F.max("_dd").alias("max_dd"),
        F.when(F.max("_peak") > 0, F.max("_dd") / (F.max("_peak") + 1e-10) * 100).otherwise(0.0).alias("max_dd_pct"),
        F.min("_cdd").alias("max_dd_compounded"),
        F.max("_losses").alias("max_losses"),
    )


def risk(trades: DataFrame, pnl: str = "pnl") -> DataFrame:
    """Per series: Sharpe, Sortino, profit factor, mean win and loss in percent, their ratio, and the t of the mean."""
    p = F.col(pnl)
    win, loss = F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)), F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0))
    return trades.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_trades"), sharpe(pnl).alias("sharpe"), sortino(pnl).alias("sortino"), profit_factor(pnl).alias("profit_factor"),
        (win * 100).alias("avg_win"), (loss * 100).alias("avg_loss"), F.when(loss != 0, F.abs(win / loss)).alias("win_loss_ratio"), t_statistic(pnl).alias("t_statistic"),
    )


def _drawn(seed: int) -> Column:
    """A digest of (seed, run, trade): the same on every cluster and in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("run").cast("string"), F.col("entry_dt").cast("string"), F.col("signal_dt").cast("string")))


def _each_run(trades: DataFrame, runs: int, pnl: str) -> DataFrame:
    rows = trades.select(*KEYS, "entry_dt", "signal_dt", F.col(pnl).alias("pnl"))
    return rows.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def monte_carlo(trades: DataFrame, runs: int = 300, seed: int = 7, pnl: str = "pnl", min_trades: int = 5) -> DataFrame:
    """Per series with enough trades: final PnL, and median and 95 % largest drawdown, in percent, over shuffled orders.

    A shuffle is an order by a digest of (seed, run, trade), so it is the same on every cluster; each (series, run) is a
    window of its own.
    """
    enough = trades.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_trades).select(*KEYS)
    rows = _each_run(trades.join(enough, KEYS, "left_semi"), runs, pnl)
    w = Window.partitionBy(*KEYS, "run").orderBy(_drawn(seed), "entry_dt", "signal_dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("pnl").over(w))
    rows = rows.withColumn("_fall", F.max("_sum").over(w) - F.col("_sum"))
    each = rows.groupBy(*KEYS, "run").agg(F.sum("pnl").alias("final"), F.max("_fall").alias("fall"))
    return each.groupBy(*KEYS).agg((F.avg("final") * 100).alias("mean_final_pnl"), (F.percentile("fall", 0.5) * 100).alias("median_max_dd"), (F.percentile("fall", 0.95) * 100).alias("p95_max_dd"), F.count(F.lit(1)).alias("runs"))


#: Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...; past the last one a draw has no chance in 52 bits.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18))


def bootstrap(trades: DataFrame, runs: int = 300, seed: int = 7, pnl: str = "pnl", min_trades: int = 5) -> DataFrame:
    """Per series: mean, 95 % interval, worst and best final PnL in percent over resamples of its trades with replacement.

    A run draws each trade as often as a Poisson variable of mean 1 says, made from a digest of (seed, run, trade), so
    runs need neither a driver nor each other and add up map-side in one pass; a run's sum is scaled to the number of
    trades.  A series of fewer than ``min_trades`` trades has a row of nulls.
    """
    draw = F.conv(F.substring(_drawn(seed), 1, 13), 16, 10).cast("double") / float(1 << 52)
    times = sum(((draw >= p).cast("int") for p in POISSON), F.lit(0))
    rows = _each_run(trades, runs, pnl).withColumn("_w", F.when(F.col("pnl").isNotNull(), times))
    each = rows.groupBy(*KEYS, "run").agg(F.sum(F.col("_w") * F.col("pnl")).alias("sum"), F.sum("_w").alias("w"), F.count("pnl").alias("n"))
    final = F.when(F.col("n") >= min_trades, F.col("sum") / F.when(F.col("w") > 0, F.col("w")) * F.col("n")) * 100
    each = each.select(*KEYS, "n", final.alias("final"))
    return each.groupBy(*KEYS).agg(
        F.max("n").alias("n_trades"), F.count("final").alias("runs"), F.avg("final").alias("mean_final_pnl"), F.percentile("final", 0.025).alias("ci_lower"), F.percentile("final", 0.975).alias("ci_upper"),
        F.min("final").alias("worst_case"), F.max("final").alias("best_case"),
    )


def splits(bars: DataFrame, train: float = 0.7, warm_up: int = 0) -> DataFrame:
    """Adds split (train or test) by position after dropping ``warm_up`` bars of series that are longer than that."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    out = bars.withColumns({"_no": bar_no(), "_n": n})
    out = out.where((F.col("_n") <= warm_up) | (F.col("_no") > warm_up))
    skipped = F.when(F.col("_n") > warm_up, F.lit(warm_up)).otherwise(F.lit(0))
    return out.withColumn("split", F.when(F.col("_no") - skipped <= share(F.col("_n") - skipped, train), "train").otherwise("test")).drop("_no", "_n")
