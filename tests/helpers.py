"""Small bar tables for tests."""

from __future__ import annotations

import datetime as dt

SCHEMA = "symbol string, interval string, open_dt timestamp_ntz, open double, high double, low double, close double, volume double"
START = dt.datetime(2024, 1, 1)


def bars(spark, rows, symbol="X", interval="1h", step=1, extra=""):
    """rows: (open, high, low, close[, volume[, more]]) of consecutive hours; ``extra`` names further columns."""
    data = [(symbol, interval, START + dt.timedelta(hours=i * step), *(float(x) for x in r[:4]), float(r[4]) if len(r) > 4 else 1.0, *r[5:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA + (", " + extra if extra else ""))


def wave(n: int, base: float = 100.0):
    """Deterministic prices that rise and fall."""
    out, last = [], base
    for i in range(n):
        close = last + (1.2, -0.8, 0.9, -0.6, 1.1, -0.7, 0.5, -0.4)[i % 8] + ((i * 7919) % 13 - 6) / 10
        out.append((last, max(last, close) + 0.5, min(last, close) - 0.4, close, 100 + (i * 31) % 17))
        last = close
    return out
