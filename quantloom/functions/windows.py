"""Windows over a series: one partitioning and one order for all, so a pipeline plans one exchange and one sort."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEYS = ["symbol", "interval"]


def series():
    """The window of a series in time order."""
    return Window.partitionBy(*KEYS).orderBy("open_dt")


def roll(n: int):
    """The last n bars."""
    return series().rowsBetween(-(n - 1), 0)


def ahead(first: int, last: int):
    """Bars from ``first`` to ``last`` after the current one."""
    return series().rowsBetween(first, last)


def full(value: Column, counted: Column, n: int, window=None) -> Column:
    """``value`` where all n bars of the window have ``counted``; else null."""
    return F.when(F.count(counted).over(window if window is not None else roll(n)) == n, value)


def prev(column: str | Column, k: int = 1) -> Column:
    return F.lag(column, k).over(series())


def following(column: str | Column, k: int = 1) -> Column:
    return F.lead(column, k).over(series())


def yes(condition: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def bar_no() -> Column:
    """Position of a bar in its series, from 1."""
    return F.row_number().over(series())


def share(n: Column, part: float) -> Column:
    """The whole bars in a ``part`` of n, by the part's decimal digits: 0.7 of 720 are 504, which products of doubles miss."""
    return F.floor(n * F.lit(Decimal(str(part)))).cast("long")
