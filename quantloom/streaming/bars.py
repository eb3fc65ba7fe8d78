"""Bars and recursive state from a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.sources.bars import PRICES

_WIDTH = {"hour": "1 hour", "day": "1 day", "minute": "1 minute"}


def read_ticks(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_bars(ticks: DataFrame, symbol: str, ts: str, value: str, tie: str, unit: str = "hour", interval: str = "1h", delay: str = "2 hours") -> DataFrame:
    """Closed bars (append mode): a bar comes out once the watermark passes its end; later ticks are dropped.

    Bars open by the clock of the session's zone, as those of ``bars_from_ticks`` do: times are shifted to that clock first,
    so ``delay`` has to cover the hour that a clock is set back.
    """
    zone = ticks.sparkSession.conf.get("spark.sql.session.timeZone")
    own = ticks.where(F.col(value).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp"))
    timed = own.withColumn("_ts", F.from_utc_timestamp("_at", zone)).withWatermark("_ts", delay)
    order = F.struct("_at", tie)
    bars = timed.groupBy(F.col(symbol).alias("symbol"), F.window("_ts", _WIDTH[unit]).alias("w")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    opened = F.expr("timestampadd(MICROSECOND, unix_micros(w.start), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return bars.select("symbol", F.lit(interval).alias("interval"), opened.alias("open_dt"), *PRICES, "volume")


def stream_ema(bars: DataFrame, span: int = 20) -> DataFrame:
    """(symbol, open_dt, close, ema) with each series' mean kept as state; bars of a trigger are taken in time order.

    A bar without a close has the mean before it and leaves the state alone.  A bar that is not later than the series'
    last one has come too late to count: its ema is null and the state stays.
    """
    a = 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("open_dt")
        last, seen = state.get if state.exists else (None, None)
        out = []
        for t, x in zip(rows["open_dt"].astype("int64").tolist(), rows["close"].tolist(), strict=True):
            if seen is not None and t <= seen:
                out.append(None)
                continue
            seen = t
            if x is not None and x == x:
                last = float(x) if last is None else (1 - a) * last + a * x
            out.append(last)
        state.update((last, seen))
        yield pd.DataFrame({"symbol": key[0], "open_dt": rows["open_dt"].to_numpy(), "close": rows["close"].to_numpy(), "ema": out})

    own = bars.select("symbol", "open_dt", "close")
    return own.groupBy("symbol").applyInPandasWithState(step, "symbol string, open_dt timestamp_ntz, close double, ema double", "last double, seen long", "append", GroupStateTimeout.NoTimeout)
