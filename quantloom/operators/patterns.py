"""Candle patterns and colour sequences as boolean columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import prev, roll, yes, series
from quantloom.operators.indicators import candles

#: Direction of each pattern.
DIRECTIONS = {
    "bullish_engulfing": "bull", "bearish_engulfing": "bear", "bullish_harami": "bull", "bearish_harami": "bear", "three_inside_up": "bull",
    "hammer": "bull", "hanging_man": "bear", "doji": "bull", "morning_star": "bull", "evening_star": "bear",
    "three_white_soldiers": "bull", "three_black_crows": "bear", "shooting_star": "bear",
}


def _body(k: int) -> tuple[Column, Column]:
    """(lower, upper) end of the body k bars ago."""
    o, c = (F.col("open"), F.col("close")) if k == 0 else (prev("open", k), prev("close", k))
    return F.least(o, c), F.greatest(o, c)


def pattern_columns(small: float = 0.4, doji: float = 0.1) -> dict[str, Column]:
    """Condition of each pattern over bars with candle columns; missing earlier bars make it false."""
    bull, bear, close = F.col("is_bull"), F.col("is_bear"), F.col("close")
    (low0, up0), (low1, up1), (low2, up2) = _body(0), _body(1), _body(2)
    bull1, bear1, bull2, bear2 = prev("is_bull"), prev("is_bear"), prev("is_bull", 2), prev("is_bear", 2)
    covers, inside = (up0 >= up1) & (low0 <= low1), (up0 <= up1) & (low0 >= low1)
    body, upper, lower = F.col("body"), F.col("upper_wick"), F.col("lower_wick")
    middle2 = (prev("open", 2) + prev("close", 2)) / 2
    foot, head = (lower >= 2 * body) & (upper <= 0.5 * body), (upper >= 2 * body) & (lower <= 0.5 * body)
    star = prev("body_rel") <= small
    rules = {
        "bullish_engulfing": bear1 & bull & covers,
        "bearish_engulfing": bull1 & bear & covers,
        "bullish_harami": bear1 & bull & inside,
        "bearish_harami": bull1 & bear & inside,
        "three_inside_up": bear2 & bull1 & (up1 <= up2) & (low1 >= low2) & bull & (close > prev("close")),
        "hammer": bull & foot,
        "hanging_man": (F.col("body_rel") <= small) & foot,
        "doji": F.col("body_rel") <= doji,
        "morning_star": bear2 & star & bull & (close >= middle2),
        "evening_star": bull2 & star & bear & (close <= middle2),
        "three_white_soldiers": bull & bull1 & bull2 & (close > prev("close")) & (prev("close") > prev("close", 2)),
        "three_black_crows": bear & bear1 & bear2 & (close < prev("close")) & (prev("close") < prev("close", 2)),
        "shooting_star": (F.col("body_rel") <= small) & head,
    }
    return {name: yes(c) for name, c in rules.items()}


def patterns(bars: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Bars with candle columns and one boolean column for each pattern."""
    rules = pattern_columns()
    return candles(bars).withColumns({n: rules[n] for n in names or rules})


def colour() -> Column:
    """1 for a green bar, -1 for a red one, 0 for neither."""
    return F.signum(F.col("close") - F.col("open")).cast("int")


def sequence_match(bars: DataFrame, pattern: Sequence[int], name: str = "matched") -> DataFrame:
    """Adds ``name``: the bar ends the sequence of colours (1, -1), oldest first; 0 never matches."""
    if not pattern or any(p not in (1, -1) for p in pattern):
        raise ValueError("a pattern is made of 1 and -1")
    out, n = bars.withColumn("_colour", colour()), len(pattern)
    ok = F.lit(True)
    for k, want in enumerate(reversed(pattern)):
        ok = ok & ((F.col("_colour") if k == 0 else F.lag("_colour", k).over(series())) == want)
    return out.withColumn(name, yes(ok) & F.lit(n > 0)).drop("_colour")


def streak_match(bars: DataFrame, n: int, bit: str = "target_bit", name: str = "matched", min_body: float | None = None) -> DataFrame:
    """Adds ``name``: the last n bars all have ``bit``; longer runs match at each further bar.

    With ``min_body`` the bodies of the n bars (body_pct) must add up to at least that.
    """
    hit = F.sum(F.col(bit).cast("int")).over(roll(n)) == n
    if min_body is not None:
        hit = hit & (F.sum("body_pct").over(roll(n)) >= min_body)
    return bars.withColumn(name, yes(hit))


def two_segments(first: tuple[str, int], second: tuple[str, int]) -> list[int]:
    """A sequence of two runs, each given as its colour (green or red) and its length."""
    return [1 if colour == "green" else -1 for colour, n in (first, second) for _ in range(n)]


def profile(sequence: list[int]) -> dict[str, int]:
    """What a sequence of 1 and -1 is made of, and the colour that is expected after it: the other one than its last."""
    if not sequence or any(x not in (1, -1) for x in sequence):
        raise ValueError(f"no sequence of 1 and -1: {sequence}")
    return {"rises": sequence.count(1), "drops": sequence.count(-1), "last": sequence[-1], "expected": -sequence[-1]}
