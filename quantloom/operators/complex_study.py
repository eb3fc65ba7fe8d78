"""The complex streak study: matches with what followed them, their scores, and the odds by intervals.

A match is the last bar of a segment of bars up and bars down (``pullback_quality`` says how it retraced); C1 and C2 are
the bars after it.  Matches without a C1 are left out; a follow-up without body counts as red.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import KEYS, following, yes
from quantloom.operators.streak import pullback_quality, signal_score

#: Stands for an RSI that is not known yet (a fixed value).
UNKNOWN_RSI = 50.0


def follow_ups(bars: DataFrame, matched: str, rise: int = 3, drop: int = 2, expected: str = "green") -> DataFrame:
    """Scored matches with c1 and c2: their times, colours, returns in percent and whether they went as ``expected``.

    Needs rsi_sma; c2's columns are null where it does not exist yet.
    """
    out = bars
    for k in (1, 2):
        o, c = following("open", k), following("close", k)
        colour = F.when(following("open_dt", k).isNotNull(), F.when(yes(c > o), "green").otherwise("red"))
        out = out.withColumns({f"c{k}_dt": following("open_dt", k), f"c{k}_color": colour, f"c{k}_ret": F.when(o != 0, (c - o) / o * 100)})
    out = out.withColumn("rsi", F.coalesce("rsi_sma", F.lit(UNKNOWN_RSI)))
    out = signal_score(pullback_quality(out, matched, rise, drop), "rsi").where("c1_dt IS NOT NULL")
    return out.withColumns({f"c{k}_success": F.col(f"c{k}_color") == expected for k in (1, 2)})


def comparative_report(matches: DataFrame) -> DataFrame:
    """Per series: matches, how many of them C1 confirmed, and mean RSI and volume ratio of both kinds."""
    good = F.col("c1_success")
    return matches.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failure"), (F.count_if(good) / F.count(F.lit(1)) * 100).alias("success_rate"),
        *[F.avg(F.when(good if s == "success" else ~good, F.col(c))).alias(f"{s}_{c}") for s in ("success", "failure") for c in ("rsi", "vol_ratio")],
    )


def with_green(matches: DataFrame) -> DataFrame:
    """Adds c1_green: what the interval studies count, a green C1."""
    return matches.withColumn("c1_green", F.col("c1_color") == "green")
