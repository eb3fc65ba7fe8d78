"""Registration of queries and pieces of SQL that their twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Bars as common table expressions, each with rn, the place of a bar in its series.
EVENT_BARS = """bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_dt) AS rn FROM (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS open_dt, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2))"""
ORDER_BARS = """bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_dt) AS rn FROM (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS open_dt, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2))"""
#: The window of a series.
W = "PARTITION BY symbol ORDER BY open_dt"


def register(sql: str | None = None):
    """Registers a query under its function's name, with the equivalent SQL if there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def frame(a: int, b: int) -> str:
    side = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"OVER ({W} ROWS BETWEEN {side(a)} AND {side(b)})"


def rolled(aggregate: str, column: str, n: int) -> str:
    """An aggregate over the last n bars, null until there are n values."""
    return f"CASE WHEN count({column}) {frame(1 - n, 0)} = {n} THEN {aggregate}({column}) {frame(1 - n, 0)} END"


def r6(column: str | Column) -> Column:
    """Six decimals; adding 0 turns -0 into 0."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def s6(value: str, name: str | None = None) -> str:
    return f"round({value}, 6) + 0.0::DOUBLE AS {name or value}"


def show(df: DataFrame, exact: list[str], rounded: list[str], ts: list[str] = ["open_dt"]) -> DataFrame:  # noqa: B006
    """symbol, times as text, columns as they are (counts as long), and rounded ones."""
    kinds = dict(df.dtypes)
    keep = [F.col(c).cast("long").alias(c) if kinds[c] in ("int", "tinyint", "smallint") else F.col(c) for c in exact]
    return df.select("symbol", *[F.col(t).cast("string").alias(t) for t in ts], *keep, *[r6(c).alias(c) for c in rounded])


SHOWN = "symbol, open_dt::VARCHAR AS open_dt"

BB = f"""bb AS (SELECT *, mid + 2 * sd AS up, mid - 2 * sd AS dn, coalesce(low <= mid - 2 * sd, false) AS t_low, coalesce(low <= mid AND mid <= high, false) AS t_mid, coalesce(high >= mid + 2 * sd, false) AS t_up
  FROM (SELECT *, {rolled('avg', 'close', 20)} AS mid, {rolled('stddev_samp', 'close', 20)} AS sd, {rolled('avg', 'close', 50)} AS sma50, {rolled('avg', 'close', 5)} AS sma5, {rolled('avg', 'close', 20)} AS sma20 FROM bars))"""


def sql_t_two_sided(t: str, df: str) -> str:
    """Two-sided p of Student's t: the incomplete beta function by its continued fraction, 200 terms."""

    def tail(a: str, b: str, x: str) -> str:
        m = "floor((e.j + 1) / 2)"
        num = f"CASE WHEN e.j % 2 = 1 THEN {m} * ({b} - {m}) * {x} / (({a} + 2 * ({m}) - 1) * ({a} + 2 * ({m}))) ELSE -({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * ({m})) * ({a} + 2 * ({m}) + 1)) END"
        c, d = f"(1 + ({num}) / s.c)", f"(1 / (1 + ({num}) * s.d))"
        first = f"1 / (1 - ({a} + {b}) * {x} / ({a} + 1))"
        steps = f"[{{'j': 0::DOUBLE, 'c': 1::DOUBLE, 'd': {first}, 'h': {first}}}] || list_transform(range(1, 401), lambda j: {{'j': j::DOUBLE, 'c': 0::DOUBLE, 'd': 0::DOUBLE, 'h': 0::DOUBLE}})"
        front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x}))"
        return f"{front} / {a} * list_reduce({steps}, lambda s, e: {{'j': e.j, 'c': {c}, 'd': {d}, 'h': s.h * {c} * {d}}}).h"

    a, x = f"({df} / 2.0::DOUBLE)", f"({df} / ({df} + {t} * {t}))"
    y = f"({t} * {t} / ({df} + {t} * {t}))"
    return f"CASE WHEN {t} = 0 THEN 1.0 WHEN {x} < ({a} + 1) / ({a} + 2.5) THEN {tail(a, '0.5::DOUBLE', x)} ELSE 1 - {tail('0.5::DOUBLE', a, y)} END"
