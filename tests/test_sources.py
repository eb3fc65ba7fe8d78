"""Readers, writers, journal, presets and the stream."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import pytest
from helpers import bars, wave

from pyspark.sql import functions as F

from quantloom.functions import folds
from quantloom.sources import bars as S
from quantloom.sources.journal import Journal, read_presets, write_presets
from quantloom.streaming.bars import read_ticks, stream_bars, stream_ema


def test_csv_reader(spark, tmp_path):
    ms = 1_704_067_200_000
    (tmp_path / "BTCUSDT-1mo-merged.csv").write_text(f"open_time,open,high,low,close,volume\n{ms},1,2,0.5,1.5,10\n{ms * 1000},1,2,0.5,1.5,10\n")
    got = S.read_csv(spark, str(tmp_path / "*.csv")).collect()
    assert [(r.symbol, r.interval, r.open_dt, r.close) for r in got] == [("BTC", "1M", dt.datetime(2024, 1, 1), 1.5)]


def test_parquet_round_trip_and_discovery(spark, tmp_path):
    path = str(tmp_path / "bars")
    S.write_parquet(bars(spark, wave(5)).union(bars(spark, wave(3), "Y", "1d")), path)
    assert S.read_parquet(spark, path).count() == 8
    assert [(r.symbol, r.minutes) for r in S.timeframes(spark, path).collect()] == [("X", 60), ("Y", 1440)]


def test_load_tries_the_next_path(spark, tmp_path):
    path = str(tmp_path / "bars")
    S.write_parquet(bars(spark, wave(5)), path)
    assert S.load(spark, [str(tmp_path / "none"), path]).count() == 5
    with pytest.raises(ValueError):
        S.load(spark, [str(tmp_path / "none")])


def test_violations(spark):
    df = bars(spark, [(1, 2, 0.5, 1), (1, float("nan"), 0.5, 1), (1, 0.4, 0.5, 1), (3, 2, 0.5, 1), (1, 2, 0.5, 0.4)])
    assert [r.violation for r in S.violations(df).orderBy("open_dt").collect()] == ["not finite", "high under low", "open outside", "close outside"]
    with pytest.raises(ValueError):
        S.require_columns(df, ["absent"])


def test_journal(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "journal"))
    assert j.rows().count() == 0
    j.insert(spark.createDataFrame([("BTC", 2.5), ("ETH", -1.0)], "symbol string, pnl_pct double"))
    j.insert(spark.createDataFrame([("SOL", 1.0)], "symbol string, pnl_pct double"))
    assert sorted((r.id, r.symbol) for r in j.rows().collect()) == [(1, "BTC"), (2, "ETH"), (3, "SOL")]
    j.delete([2])
    assert j.totals().first()[:] == (2, 2, 0, 3.5)
    (tmp_path / "old.csv").write_text("id,symbol,pnl_pct\n1,BTC,2.5\n2,ADA,x\n")
    j.import_csv(str(tmp_path / "old.csv"))
    assert sorted(r.symbol for r in j.rows().collect()) == ["ADA", "BTC", "SOL"]


def test_presets(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"a": {"coin": "BTC", "interval": "1h", "strat_id": "RSI", "direction": "Long", "params": {"tp": 2.0}}}, indent=1))
    got = read_presets(spark, str(tmp_path / "p.json"))
    write_presets(got, str(tmp_path / "out"))
    assert read_presets(spark, str(tmp_path / "out")).collect() == got.collect()
    assert got.first().params == {"tp": 2.0}


def test_stream_equals_batch(spark, tmp_path):
    """Streamed bars are the batch bars that the watermark has closed, and the streamed mean is the batch mean."""
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ticks.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    args = ("event_type", "ts", "value", "event_id")
    live = stream_bars(read_ticks(spark, str(tmp_path / "in"), ticks.schema), *args)
    query = live.writeStream.format("memory").queryName("live_bars").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    end = ticks.agg(F.max("ts")).first()[0] - dt.timedelta(hours=2)
    want = S.bars_from_ticks(ticks, *args).where(F.col("open_dt") + F.expr("INTERVAL 1 HOUR") <= F.lit(end))
    got = spark.table("live_bars").orderBy("symbol", "open_dt").toPandas()
    pd.testing.assert_frame_equal(got, want.orderBy("symbol", "open_dt").toPandas(), check_dtype=False)

    want.coalesce(1).write.parquet(str(tmp_path / "bars"))
    means = stream_ema(spark.readStream.schema(want.schema).parquet(str(tmp_path / "bars")))
    query = means.writeStream.format("memory").queryName("live_ema").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("live_ema").orderBy("symbol", "open_dt").toPandas()
    want = folds.fold(want, ["ema_20"]).orderBy("symbol", "open_dt").toPandas()
    assert got["ema"].tolist() == pytest.approx(want["ema_20"].tolist())


def test_csv_columns_are_found_by_name(spark, tmp_path):
    ms = 1_704_067_200_000
    (tmp_path / "BTCUSDT-1h-merged.csv").write_text(f"open_time, Close ,high,low,open,volume,extra\n{ms},1.5,2,0.5,1,10,x\n{ms + 3_600_000},1.6,2,0.5,1.5,10,x\n")
    (tmp_path / "ETHUSDT-1d-merged.csv").write_text("datetime,open,high,low,close,volume\n2024-01-01 00:00:00,7,9,6,8,1\n")
    got = {(r.symbol, r.open_dt.hour): (r.open, r.high, r.low, r.close) for r in S.read_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("BTC", 0): (1, 2, 0.5, 1.5), ("BTC", 1): (1.5, 2, 0.5, 1.6), ("ETH", 0): (7, 9, 6, 8)}
    (tmp_path / "XRPUSDT-1d-merged.csv").write_text("open_time,open,high,low,close\n1,1,1,1,1\n")
    with pytest.raises(ValueError, match="volume"):
        S.read_csv(spark, str(tmp_path / "*.csv"))


def test_small_source_helpers(spark, tmp_path):
    a, b = bars(spark, wave(5)), bars(spark, wave(3), "Y", "1d")
    S.write_parquet(a, str(tmp_path / "a"))
    S.write_parquet(b.union(a), str(tmp_path / "b"))
    assert S.load_all(spark, [str(tmp_path / "none"), str(tmp_path / "a"), str(tmp_path / "b")]).count() == 8
    assert S.page_totals(a, 2).first()[:] == (5, 3) and S.page(a, ["open_dt"], 3, 2).count() == 1
    odd = bars(spark, [(1, 2, 0.5, float("nan")), (1, 2, 0.5, 1.0)])
    assert S.drop_incomplete(odd, ["close", "absent"]).count() == 1
    assert json.loads(S.sane_json(odd.select("close")).first().json) in ({"close": None}, {"close": 1.0})
    out = S.export(a, "cache", 2).first()
    assert out.n_records == 2 and out.source == "cache" and json.loads(out.records)[1]["close"] == wave(5)[4][3]
    assert S.time_index(a.withColumnRenamed("open_dt", "datetime")).columns[0] == "open_dt"
    with pytest.raises(ValueError):
        S.time_index(a.drop("open_dt"))


def test_resample_in_another_zone(spark):
    day = bars(spark, wave(30))
    want = {(r.open_dt, r.close) for r in S.resample(day, "1 day", "1d").collect()}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {(r.open_dt, r.close) for r in S.resample(day, "1 day", "1d").collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {t.hour for t, _ in want} == {0}


def test_journal_writers_do_not_undo_each_other(spark, tmp_path, monkeypatch):
    one, two = Journal(spark, str(tmp_path / "j")), Journal(spark, str(tmp_path / "j"))
    row = lambda x: spark.createDataFrame([(x, 1.0)], "symbol string, pnl_pct double")
    one.insert(row("A"))
    claim, other = Journal._claim, []

    def late(self, number):  # another writer publishes between reading and claiming
        if self is one and not other:
            other.append(1)
            two.insert(row("B"))
        return claim(self, number)

    monkeypatch.setattr(Journal, "_claim", late)
    one.insert(row("C"))
    assert sorted((r.id, r.symbol) for r in two.rows().collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_stream_mean_of_missing_and_late_bars(spark, tmp_path):
    rows = bars(spark, [(1, 1, 1, c) for c in (1.0, 2.0, 3.0)])
    first = rows.withColumn("close", F.when(F.col("close") != 2.0, F.col("close")))
    late = bars(spark, [(1, 1, 1, 9.0)])
    for i, part in enumerate((first, late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
        query = stream_ema(spark.readStream.schema(part.schema).parquet(str(tmp_path / "bars")), 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.open_dt.hour, r.close or 0, r.ema) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.ema is not None)
    assert got == [(0, 1.0, 1.0), (1, 0, 1.0), (2, 3.0, 2.0)]


def test_load_all_reports_files_it_cannot_read(spark, tmp_path):
    (tmp_path / "BTCUSDT-1h-merged.csv").write_text("open_time,open,high,low,close,volume\n1704067200000,1,2,0.5,1.5,10\n")
    (tmp_path / "ETHUSDT-1h-merged.csv").write_text("open_time,open,high,low,close\n1704067200000,1,2,0.5,1.5\n")
    paths = [str(tmp_path / f"{c}USDT-1h-merged.csv") for c in ("BTC", "ETH", "XRP")]
    with pytest.raises(ValueError, match="volume"):
        S.load_all(spark, paths)
    assert S.load_all(spark, [paths[0], paths[2]]).count() == 1
    with pytest.raises(S.NoBars):
        S.load_all(spark, paths[2:])


@pytest.mark.parametrize(("zone", "unit", "interval"), [("America/New_York", "day", "1d"), ("Asia/Kolkata", "hour", "1h")])
def test_stream_bars_open_by_the_clock_of_the_zone(spark, tmp_path, zone, unit, interval):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ticks = spark.sql("SELECT 'X' AS s, timestamp_seconds(1704067200 + id * 2700) AS ts, cast(id % 17 AS double) AS v, id FROM range(200)")
        ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
        args = ("s", "ts", "v", "id", unit, interval)
        live = stream_bars(read_ticks(spark, str(tmp_path / "in"), ticks.schema), *args)
        live.writeStream.format("memory").queryName(f"zone_{unit}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got, want = spark.table(f"zone_{unit}").collect(), S.bars_from_ticks(ticks, *args).collect()
        assert len(got) > 2 and set(got) <= set(want)
        assert unit == "hour" or {r.open_dt.hour for r in got} == {0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_journal_is_a_log(spark, tmp_path):
    """A change stores its own rows only; updates, tombstones and compaction give the newest rows."""
    root = tmp_path / "j"
    j = Journal(spark, str(root))
    j.insert(spark.range(2000).select(F.col("id").cast("double").alias("pnl_pct"), F.lit("A").alias("symbol")).repartition(3))
    assert j.rows().agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()[:] == (1, 2000, 2000)
    assert j.rows().where("id <> pnl_pct + 1").count() == 0  # in the order of the columns
    size = lambda: {p.name: spark.read.parquet(str(p)).count() for p in root.iterdir() if p.is_dir()}
    before = size()
    j.insert(spark.createDataFrame([("B", 1.0)], "symbol string, pnl_pct double"))
    j.delete([1, 2, 99999])
    j.update(spark.createDataFrame([(3, "C", 7.0)], "id long, symbol string, pnl_pct double"))
    after = size()
    assert before.items() <= after.items() and sorted(n for k, n in after.items() if k not in before) == [1, 1, 3]
    state = lambda: {(r.id, r.symbol, r.pnl_pct) for r in j.rows().where("id < 5 OR id > 1999").collect()}
    want = {(3, "C", 7.0), (4, "A", 3.0), (2000, "A", 1999.0), (2001, "B", 1.0)}
    assert state() == want and j.rows().count() == 1999
    j.compact()
    j.vacuum()
    assert len(size()) == 1 and state() == want and j.rows().count() == 1999
    j.insert(spark.createDataFrame([("D", 2.0)], "symbol string, pnl_pct double"))
    assert j.rows().where("symbol = 'D'").first().id == 2002
    j.insert(spark.createDataFrame([], "symbol string, pnl_pct double"))
    assert j.rows().count() == 2000


def test_quoted_commas_stay_in_their_cell(spark, tmp_path):
    (tmp_path / "BTCUSDT-1h-merged.csv").write_text('open_time,"note, long",open,high,low,close,volume\n1704067200000,"a, b, c",1,2,0.5,1.5,10\n1704070800000,plain,"2",3,1.5,2.5,20\n')
    got = [(r.open, r.high, r.low, r.close, r.volume) for r in S.read_csv(spark, str(tmp_path / "*.csv")).orderBy("open_dt").collect()]
    assert got == [(1, 2, 0.5, 1.5, 10), (2, 3, 1.5, 2.5, 20)]
