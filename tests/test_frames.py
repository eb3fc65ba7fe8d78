"""Long frames against Spark's own, and as-of joins over buckets against a walk."""

from __future__ import annotations

import bisect
import datetime as dt
import random

import pytest
from helpers import START, bars, wave

from pyspark.sql import functions as F

from quantloom.functions import frames
from quantloom.functions.windows import KEYS, ahead, full, roll
from quantloom.operators import joins as J


def _series(spark):
    rng = random.Random(6)
    rows = [(*r[:4], float("nan") if rng.random() < 0.02 else r[4]) for r in wave(130)]
    out = bars(spark, rows).union(bars(spark, wave(37), "Y")).union(bars(spark, wave(5), "Z"))
    return out.withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))


@pytest.mark.parametrize("n", [1, 2, 7, 20, 37, 60, 200])
def test_last_bars_equal_frames(spark, n):
    df = _series(spark)
    wanted = {f"{k}_{c}": (k, c) for k in frames.KINDS for c in ("close", "volume")}
    plain = {"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg, "stddev": F.stddev_samp}
    out = frames.last_bars(df, n, wanted).withColumns({f"w_{k}_{c}": full(plain[k](c).over(roll(n)), F.col(c), n) for k, c in wanted.values()})
    for r in out.collect():
        for name in wanted:
            assert (r[name] is None) == (r[f"w_{name}"] is None), (n, name, r)
            assert r[name] is None or r[name] == pytest.approx(r[f"w_{name}"], rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 7, 20, 37, 129, 200])
def test_next_bars_equal_frames(spark, n):
    df = _series(spark)
    out = frames.next_bars(df, n, {"hi": ("max", "high"), "lo": ("min", "volume")})
    out = out.withColumns({"w_hi": F.max("high").over(ahead(1, n)), "w_lo": F.min("volume").over(ahead(1, n))})
    assert out.where("NOT (hi <=> w_hi) OR NOT (lo <=> w_lo)").count() == 0


@pytest.mark.parametrize("days", [1, 3, 1000])
def test_asof_over_buckets_equals_a_walk(spark, days):
    rng = random.Random(days)
    at = lambda: START + dt.timedelta(hours=rng.randrange(0, 24 * 40))
    left = [(rng.choice("ABC"), at(), i) for i in range(300)]
    right = [(s, t, None if rng.random() < 0.1 else rng.random()) for s, t in {(rng.choice("ABD"), at()) for _ in range(25)}]
    got = J.asof(spark.createDataFrame(left, "symbol string, open_dt timestamp_ntz, i int"), spark.createDataFrame(right, "symbol string, open_dt timestamp_ntz, x double"), ["x", "open_dt"], "r", days=days)
    want = {}
    for s, t, i in left:
        own = sorted(((rt, x) for rs, rt, x in right if rs == s), key=lambda v: v[0])
        k = bisect.bisect_right([rt for rt, _ in own], t) - 1
        want[i] = (own[k][1], own[k][0]) if k >= 0 else (None, None)
    assert {r.i: (r.x_r, r.open_dt_r) for r in got.collect()} == want


def test_asof_of_one_series_is_many_buckets(spark):
    df = bars(spark, wave(5000))
    plan = J.asof(df, df, ["close"], "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan
    assert df.select(F.floor(F.unix_date(F.to_date("open_dt")) / J.BUCKET_DAYS)).distinct().count() == 7


def test_semi(spark):
    df = bars(spark, wave(6)).union(bars(spark, wave(6), "Y"))
    times = spark.createDataFrame([("X", START), ("X", START), ("Y", START + dt.timedelta(hours=5)), ("Z", START), (None, START)], "symbol string, open_dt timestamp_ntz")
    assert sorted((r.symbol, r.open_dt.hour) for r in J.semi(df, times).select(*KEYS, "open_dt").collect()) == [("X", 0), ("Y", 5)]
