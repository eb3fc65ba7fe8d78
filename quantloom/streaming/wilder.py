"""Bars and Wilder's indicators from a stream of ticks, as typed state of each series.

A series keeps its open bars and the states of RSI, ATR and Supertrend.  A timer at each bar's end closes it once the
watermark is past, followed or not, and one long after the last bar drops a series that has gone silent.  What comes out
equals the batch indicators of the closed bars, also after a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that such state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_WIDTH = {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
_BAR = "open_us long, open_tie long, open double, high double, low double, close_us long, close_tie long, close double, volume double"
_STATE = "last long, bars long, close double, gain double, loss double, atr double, wide double, upper double, lower double, falling boolean"
_OUT = "symbol string, open_ms long, open double, high double, low double, close double, volume double, rsi_14 double, atr_14 double, supertrend double, supertrend_dir int"


def _mean(old: float | None, value: float, n: int) -> float:
    return value if old is None else old + (value - old) / n


def _closed(state: tuple, bar: tuple, at: int, rsi_n: int = 14, band_n: int = 10, multiplier: float = 3.0) -> tuple[tuple, tuple]:
    """(state after the bar that opens at ``at``, its row's figures)."""
    _, bars, last, gain, loss, atr, wide, upper, lower, falling = state
    _, _, open_, high, low, _, _, close, volume = bar
    bars += 1
    span = high - low if last is None else max(high - low, abs(high - last), abs(low - last))
    atr, wide = _mean(atr, span, rsi_n), _mean(wide, span, band_n)
    if last is not None:
        gain, loss = _mean(gain, max(close - last, 0.0), rsi_n), _mean(loss, max(last - close, 0.0), rsi_n)
    line = None
    top, bottom = (high + low) / 2 + multiplier * wide, (high + low) / 2 - multiplier * wide
    if bars == band_n:
        upper, lower = top, bottom
    elif bars > band_n:
        upper = top if top < upper or last > upper else upper
        lower = bottom if bottom > lower or last < lower else lower
        falling = close <= upper if falling or upper <= lower else close < lower
    if bars >= band_n:
        line = upper if falling else lower
    rsi = None if bars <= rsi_n else 0.0 if gain + loss == 0 else 100 * gain / (gain + loss)
    row = (open_, high, low, close, volume, rsi, atr if bars >= rsi_n else None, line, 1 if line is not None and close > line else -1)
    return (at, bars, close, gain, loss, atr, wide, upper, lower, falling), row


class _Series(StatefulProcessor):
    def __init__(self, width: int, idle: int) -> None:
        self.width, self.idle = width, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "at long", _BAR)
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        late = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            part = part.assign(at=part["us"] // 1000 // self.width * self.width).sort_values(["us", "tie"], kind="stable")
            for at, ticks in part[part["at"] + self.width > late].groupby("at"):
                at, first, last = int(at), ticks.iloc[0], ticks.iloc[-1]
                new = (int(first.us), int(first.tie), float(first.value), float(ticks["value"].max()), float(ticks["value"].min()), int(last.us), int(last.tie), float(last.value), float(len(ticks)))
                if self.bars.containsKey((at,)):
                    old = tuple(self.bars.getValue((at,)))
                    begin, end = min(old, new, key=lambda b: b[:2]), max(old, new, key=lambda b: b[5:7])
                    new = (*begin[:3], max(old[3], new[3]), min(old[4], new[4]), *end[5:8], old[8] + new[8])
                else:
                    self.handle.registerTimer(at + self.width)
                self.bars.updateValue((at,), new)
        return iter(())  # bars come out when they close

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        state = tuple(self.state.get()) if self.state.exists() else (-1, 0, None, None, None, None, None, None, None, True)
        done = sorted(k[0] for k in self.bars.keys() if k[0] + self.width <= now)  # whichever timer comes first, bars close in order
        out = []
        for at in done:
            state, row = _closed(state, tuple(self.bars.getValue((at,))), at)
            out.append((key[0], at, *row))
            self.bars.removeKey((at,))
        if done:
            self.state.update(state)
            self.handle.registerTimer(state[0] + self.width + self.idle)
        elif state[0] >= 0 and now >= state[0] + self.width + self.idle and not any(True for _ in self.bars.keys()):
            self.state.clear()
        return iter([pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])] if out else [])

    def close(self) -> None:
        pass


def stream_wilder(ticks: DataFrame, symbol: str, ts: str, value: str, tie: str, unit: str = "hour", interval: str = "1h", delay: str = "2 hours", idle_days: int = 30) -> DataFrame:
    """Closed bars with rsi_14, atr_14, supertrend and its direction (append mode, RocksDB state: ``STORE``).

    Bars open by the clock of the session's zone and ticks behind the watermark are dropped, as in ``stream_bars``; ``tie``
    orders ticks of one time and is a whole number.  A series without a bar for ``idle_days`` of event time starts anew.
    """
    zone = ticks.sparkSession.conf.get("spark.sql.session.timeZone")
    timed = ticks.where(F.col(value).isNotNull()).withColumn("_ts", F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)).withWatermark("_ts", delay)
    own = timed.select(F.col(symbol).cast("string").alias("symbol"), "_ts", F.unix_micros("_ts").alias("us"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
    bars = own.groupBy("symbol").transformWithStateInPandas(_Series(_WIDTH[unit], idle_days * 86_400_000), _OUT, "Append", "EventTime")
    opened = F.expr("timestampadd(MILLISECOND, open_ms, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return bars.select("symbol", F.lit(interval).alias("interval"), opened.alias("open_dt"), *[c for c in bars.columns if c not in ("symbol", "open_ms")])
