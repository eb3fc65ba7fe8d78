"""The stateful stream against the batch indicators of the same bars."""

from __future__ import annotations

import datetime as dt

import pytest

from pyspark.sql import functions as F

from quantloom.functions import folds
from quantloom.sources import bars as S
from quantloom.streaming import wilder
from quantloom.streaming.bars import read_ticks


@pytest.fixture
def rocks(spark):
    spark.conf.set(*wilder.STORE)
    yield spark
    spark.conf.unset(wilder.STORE[0])


def _go(spark, folder, schema, out, **options):
    live = wilder.stream_wilder(read_ticks(spark, str(folder), schema, 1), "s", "ts", "v", "id", **options)
    query = live.writeStream.format("parquet").option("path", str(out / "out")).option("checkpointLocation", str(out / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_equals_batch_after_a_restart(rocks, tmp_path):
    spark = rocks
    ticks = spark.sql("SELECT if(id % 3 = 0, 'A', 'B') AS s, timestamp_seconds(1704067200 + id * 1500 + id % 7) AS ts, 100 + 10 * sin(id / 9.0) + id % 5 AS v, id FROM range(400)")
    schema = ticks.schema
    for i in range(4):  # a file after the other; the second pair after a restart
        ticks.where(F.col("id").between(i * 100, i * 100 + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i in (1, 3):
            _go(spark, tmp_path / "in", schema, tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["symbol", "open_dt"]).reset_index(drop=True)
    end = ticks.agg(F.max("ts")).first()[0] - dt.timedelta(hours=2)
    bars = S.bars_from_ticks(ticks, "s", "ts", "v", "id")
    want = folds.fold(bars, ["rsi_14", "atr_14", "supertrend"]).where(F.col("open_dt") + F.expr("INTERVAL 1 HOUR") <= F.lit(end)).toPandas()
    want = want.sort_values(["symbol", "open_dt"]).reset_index(drop=True)
    assert len(got) == len(want) > 250
    assert (got["open_dt"] == want["open_dt"]).all()
    for c in ("open", "high", "low", "close", "volume", "rsi_14", "atr_14", "supertrend", "supertrend_dir"):
        assert got[c].tolist() == pytest.approx(want[c].tolist(), nan_ok=True), c


def test_silent_series_close_and_start_anew(rocks, tmp_path):
    """A timer closes a bar that no later bar of its series follows; after long silence the state is gone."""
    spark = rocks
    rows = [("A", 0), ("A", 60), ("B", 600), ("B", 60 * 24 * 3), ("A", 60 * 24 * 3 + 10), ("B", 60 * 24 * 3 + 600), ("B", 60 * 24 * 3 + 1200)]
    schema = "s string, ts timestamp, v double, id long"
    for i, (s, minute) in enumerate(rows):
        spark.createDataFrame([(s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), 5.0 + i, i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    _go(spark, tmp_path / "in", spark.createDataFrame([], schema).schema, tmp_path, idle_days=1)
    got = sorted((r.symbol, r.open_dt.day, r.open_dt.hour, r.close, r.atr_14) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [g[:4] for g in got] == [("A", 1, 0, 5.0), ("A", 1, 1, 6.0), ("A", 4, 0, 9.0), ("B", 1, 10, 7.0), ("B", 4, 0, 8.0), ("B", 4, 10, 10.0)]
