"""Parameter sweeps: parameter sets are rows, so one job evaluates all of them on all series."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import KEYS, bar_no, share, yes
from quantloom.operators.joins import follow

FACTORS = (0.7, 0.85, 1.0, 1.15, 1.35)
#: Least and largest value, and decimals, of each parameter that is searched (fixed values).
SPACE = {
    "take_profit": (0.1, 8.0, 2), "stop_loss": (0.1, 6.0, 2), "max_hold": (4, 800, 0), "rsi_level": (50, 90, 0), "fast_len": (3, 400, 0), "slow_len": (5, 1200, 0),
    "adx_level": (5, 60, 0), "band_len": (5, 120, 0), "band_width": (0.5, 4.0, 2), "atr_len": (5, 120, 0), "keltner_width": (0.5, 4.0, 2), "volume_factor": (0.5, 10.0, 2),
    "macd_fast": (4, 40, 0), "macd_slow": (8, 80, 0), "macd_signal": (3, 30, 0),
}
#: Lengths of which the second is longer than the first in every set.
ORDERED = (("fast_len", "slow_len"), ("macd_fast", "macd_slow"))


def grid(value: float, least: float, most: float, digits: int) -> list[float]:
    """Values round a base value, held within bounds."""
    return sorted({round(min(max(value * f, least), most), digits) for f in (*FACTORS, 1.0)})


def candidates(base: Mapping[str, float], trials: int = 18, seed: str = "") -> list[dict[str, float]]:
    """``trials`` different parameter sets at most, the base first; the same for the same base and seed."""
    space = {k: grid(v, *SPACE[k]) for k, v in base.items()}
    rng = random.Random(int.from_bytes(hashlib.sha256(f"{sorted(base.items())}{seed}".encode()).digest()[:8], "big"))
    out, seen = [dict(base)], {tuple(sorted(base.items()))}
    for _ in range(max(40, 30 * trials)):
        if len(out) >= trials:
            break
        one = {k: rng.choice(v) for k, v in space.items()}
        if any(a in one and b in one and one[a] >= one[b] for a, b in ORDERED):
            continue
        if (key := tuple(sorted(one.items()))) not in seen:
            seen.add(key)
            out.append(one)
    return out


def _parameter_rows(sets: Sequence[Mapping[str, float]]) -> Column:
    """An array literal of the parameter sets."""
    return F.array(*[
        F.struct(F.lit(i).alias("param_id"), F.lit(float(s["take_profit"])).alias("take_profit"), F.lit(float(s["stop_loss"])).alias("stop_loss"), F.lit(int(s["max_hold"])).alias("max_hold"))
        for i, s in enumerate(sets)
    ])


def trade_figures() -> list[Column]:
    """n_trades, win_rate, total_pnl and avg_pnl of rows with a pnl.

    What a sum of doubles owes to the order of its rows is rounded off the total, so sets of equal trades score equally.
    """
    n, total = F.count(F.lit(1)), F.round(F.sum("pnl"), 9)
    return [n.alias("n_trades"), (F.count_if(F.col("pnl") > 0) / n * 100).alias("win_rate"), total.alias("total_pnl"), (total / n).alias("avg_pnl")]


def evaluate(bars: DataFrame, signal: str, sets: Sequence[Mapping[str, float]], train: float = 0.7) -> DataFrame:
    """(series, param_id, split, n_trades, win_rate, total_pnl, avg_pnl) of close-entry long trades under every set.

    ``split`` is train, test or full.  The path of an event is made once, to the longest horizon, and every set is applied
    to it inside the row, so the sets (as many as were passed in) multiply neither the shuffle of bars nor the paths.
    Trades whose path passes their split's end are left out of the split.
    """
    longest = max(int(s["max_hold"]) for s in sets)
    own = bars.withColumns({"bar_no": bar_no()})
    size = bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    cut = share(F.col("_n"), train)
    events = own.where(yes(F.col(signal))).select(*KEYS, "bar_no", F.col("open_dt").alias("entry_dt"), F.col("close").alias("entry_price")).join(size, KEYS)
    events = events.withColumn("split", F.when(F.col("bar_no") <= cut, "train").otherwise("test")).withColumn("_end", F.when(F.col("split") == "train", cut).otherwise(F.col("_n")))
    step = F.struct("offset", F.col("f_high").alias("high"), F.col("f_low").alias("low"), F.col("f_close").alias("close"))
    paths = follow(events, own, 1, longest, ["high", "low", "close"]).groupBy(*KEYS, "split", "bar_no", "entry_price", "_n", "_end").agg(F.sort_array(F.collect_list(step)).alias("path"))
    e = F.col("entry_price")

    def trade(s: Column) -> Column:
        stop, target = e * (1 - s["stop_loss"] / 100), e * (1 + s["take_profit"] / 100)
        ends = lambda x: (x["offset"] <= s["max_hold"]) & ((x["low"] <= stop) | (x["high"] >= target) | (x["offset"] == s["max_hold"]))
        price = F.transform(F.slice(F.filter("path", ends), 1, 1), lambda x: F.when(x["low"] <= stop, stop).when(x["high"] >= target, target).otherwise(x["close"]))
        return F.struct(s["param_id"].alias("param_id"), s["max_hold"].alias("max_hold"), ((F.get(price, F.lit(0)) - e) / e * 100).alias("pnl"))

    trials = paths.select(*KEYS, "bar_no", "_n", "_end", "split", F.inline(F.transform(_parameter_rows(sets), trade))).where("pnl IS NOT NULL")
    inside = lambda end: F.col("bar_no") + F.col("max_hold") <= F.col(end)
    trials = trials.select(*KEYS, "param_id", "pnl", F.explode(F.array_compact(F.array(F.when(inside("_end"), F.col("split")), F.when(inside("_n"), "full")))).alias("split"))
    return trials.groupBy(*KEYS, "param_id", "split").agg(*trade_figures())


def score(total: Column, mean: Column, win_rate: Column, trades: Column, liquidations: Column | None = None) -> Column:
    """Weighted PnL and win rate, less for liquidations and for few trades (the weights are fixed values)."""
    raw = total * 0.75 + mean * 0.45 + (win_rate - 50) * 0.3
    if liquidations is not None:
        raw = raw - liquidations * 3.5
    raw = raw - F.greatest(F.lit(0), 10 - trades) * 0.8
    return raw * F.greatest(F.lit(0.35), F.least(F.lit(1.0), trades / 80))


def best(results: DataFrame) -> DataFrame:
    """Per series: the set of the best score, and that score; ties go to the first set.

    The score is that of the test trades, or of all where there are none, mixed with the scores of all and of the training
    trades, less a penalty for what training promised beyond it.  Sets without test and full trades are left out.
    """
    scored = results.withColumn("score", score(F.col("total_pnl"), F.col("avg_pnl"), F.col("win_rate"), F.col("n_trades")))
    pick = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    names = ("score", "win_rate", "total_pnl", "n_trades")
    both = scored.groupBy(*KEYS, "param_id").agg(*[pick(s, c).alias(f"{s}_{c}") for s in ("train", "test", "full") for c in names])
    tested = F.col("test_score").isNotNull()
    both = both.select("*", *[F.when(tested, F.col(f"test_{c}")).otherwise(F.col(f"full_{c}")).alias(f"focus_{c}") for c in names]).where("focus_score IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # The weights of the parts.
    penalty = (
        F.abs(zero("train_win_rate") - F.col("focus_win_rate")) * 0.25
        + F.greatest(F.lit(0.0), zero("train_total_pnl") - F.col("focus_total_pnl")) * 0.15
        + F.greatest(F.lit(0), zero("train_n_trades") - F.col("focus_n_trades")) * 0.03
        + F.greatest(F.lit(0), 5 - F.col("focus_n_trades")) * 1.2
    )
    weight = F.when(tested, 0.75).otherwise(0.45)
    final = F.col("focus_score") * weight + F.coalesce("full_score", "focus_score") * (1 - weight) + F.coalesce("train_score", "focus_score") * 0.05 - penalty
    both = both.withColumn("final", final)
    return both.groupBy(*KEYS).agg(F.max_by("param_id", F.struct("final", -F.col("param_id"))).alias("param_id"), F.max("final").alias("score"))


def parameter_effects(trials: DataFrame, parameters: Sequence[str], score_column: str = "score", min_trials: int = 8, top: int = 5, least: float = 0.18) -> DataFrame:
    """(parameter, top_mean, bottom_mean, effect): parameters whose mean differs between the best and worst quarter of
    trials by ``least`` of their span or more, the ``top`` strongest.  No rows for fewer than ``min_trials`` trials.

    Trials are a few dozen rows, one per parameter set.
    """
    long = trials.select(F.col(score_column).alias("_s"), F.inline(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("v")) for p in parameters])))
    w = Window.partitionBy("parameter")
    ranked = long.withColumns({"_i": F.row_number().over(w.orderBy(F.desc("_s"), "v")), "_n": F.count(F.lit(1)).over(w)})
    quarter = F.greatest(F.lit(1), F.floor(F.col("_n") / 4))
    out = ranked.where(F.col("_n") >= min_trials).groupBy("parameter").agg(
        F.avg(F.when(F.col("_i") <= quarter, F.col("v"))).alias("top_mean"), F.avg(F.when(F.col("_i") > F.col("_n") - quarter, F.col("v"))).alias("bottom_mean"), (F.max("v") - F.min("v")).alias("_span")
    )
    out = out.withColumn("effect", F.col("top_mean") - F.col("bottom_mean")).where((F.col("_span") > 0) & (F.abs("effect") >= least * F.col("_span")))
    return out.orderBy(F.desc(F.abs("effect") / F.col("_span")), "parameter").limit(top).drop("_span")
