"""Cuts between training and test bars where 0.7 of the bars is a whole number that doubles miss (0.7 * 90 < 63)."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from helpers import START, bars, wave

from pyspark.sql import functions as F

from quantloom.functions.windows import share
from quantloom.operators import backtest, signal_sweep, sweep
from quantloom.plans.registry import ORACLES, QUERIES

#: Flat but for one bar, the 57th, whose time-out is bar 63, the last one to train on.
SPIKE = [(100, 110 if i == 56 else 100, 100, 110 if i == 56 else 100) for i in range(90)]


def test_share_of_whole_bars(spark):
    got = spark.range(1, 1000).select("id", share(F.col("id"), 0.7).alias("a"), share(F.col("id"), 0.29).alias("b"), share(F.col("id"), 0.0).alias("c"), share(F.col("id"), 1).alias("d")).collect()
    assert all((r.a, r.b, r.c, r.d) == (r.id * 7 // 10, r.id * 29 // 100, 0, r.id) for r in got)


def test_exit_sweep_trains_up_to_the_cut(spark):
    df = bars(spark, SPIKE).withColumn("sig", F.col("close") > 100)
    got = sweep.evaluate(df, "sig", [{"take_profit": 50.0, "stop_loss": 50.0, "max_hold": 6}]).collect()
    assert {(r.split, r.n_trades) for r in got} == {("train", 1), ("full", 1)}


def test_signal_sweep_trains_up_to_the_cut(spark):
    got = signal_sweep.evaluate(bars(spark, SPIKE), [{"strategy": "turtle", "channel_len": 2, "slow_len": 3}]).collect()
    assert {(r.split, r.n_trades) for r in got} == {("train", 1), ("full", 1)}


def test_back_test_splits_at_the_cut(spark):
    assert backtest.splits(bars(spark, wave(90))).where("split = 'train'").count() == 63


def test_totals_do_not_depend_on_order(spark):
    r = spark.range(256).selectExpr("CASE WHEN id < 232 THEN -2.0D WHEN id < 255 THEN 4.6D ELSE 5.8D END / 10 AS pnl").repartition(7).agg(*sweep.trade_figures()).first()
    assert (r.n_trades, r.total_pnl, r.avg_pnl) == (256, -35.24, -35.24 / 256)


@pytest.mark.parametrize("name", ["parameter_sweep", "strategy_sweep", "sweep_best"])
def test_sweeps_of_90_bars_equal_sql(spark, tmp_path, name):
    ticks = [(4 * i + j, START + dt.timedelta(hours=i, minutes=j), "view", float(round(p, 2))) for i, r in enumerate(wave(90)) for j, p in enumerate((r[0], r[1], r[2], r[3]))]
    spark.createDataFrame(ticks, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    want = con.execute(ORACLES[name]).df()[list(got.columns)]
    assert len(want) > 0 and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
