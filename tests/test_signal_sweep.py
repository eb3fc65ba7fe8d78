"""Lookups of any length against frames of that length, and candidates of all parameters."""

from __future__ import annotations

import pytest
from helpers import bars, wave

from pyspark.sql import functions as F

from quantloom.functions.windows import full, roll
from quantloom.operators import signal_sweep, sweep


@pytest.mark.parametrize("segment", [16, 23, 4096])
def test_lookups_equal_frames(spark, monkeypatch, segment):
    monkeypatch.setattr(signal_sweep, "SEGMENT", segment)
    df = bars(spark, wave(120)).union(bars(spark, wave(9, 5e6), "Y"))
    df = df.withColumn("volume", F.when(F.hour("open_dt") % 11 != 3, F.col("volume")))
    look = signal_sweep.Lookups(df, ["close", "volume"], 16)
    lengths = (1, 2, 3, 5, 8, 13, 16)
    wanted = {f"{c}_{n}": (look.mean(c, n), look.deviation(c, n) if n > 1 else None, full(F.avg(c).over(roll(n)), F.col(c), n), full(F.stddev_samp(c).over(roll(n)), F.col(c), n)) for c in ("close", "volume") for n in lengths}
    tops = {f"top_{n}": (look.greatest("high", n), F.when(F.col("bar_no") >= n, F.max("high").over(roll(n)))) for n in lengths}
    columns = {f"{k}_{i}": x for k, v in (wanted | tops).items() for i, x in enumerate(v) if x is not None}
    for r in look.bars.withColumns(columns).collect():
        for k in wanted:
            assert (r[f"{k}_0"] is None) == (r[f"{k}_2"] is None)
            assert r[f"{k}_0"] is None or r[f"{k}_0"] == pytest.approx(r[f"{k}_2"], rel=1e-12)
            if f"{k}_1" in columns and r[f"{k}_3"] is not None:
                assert r[f"{k}_1"] == pytest.approx(r[f"{k}_3"], rel=1e-6, abs=1e-5)
        assert all(r[f"{k}_0"] == r[f"{k}_1"] for k in tops)


def test_lengths_are_bounded(spark):
    with pytest.raises(ValueError):
        signal_sweep.Lookups(bars(spark, wave(3)), ["close"], signal_sweep.SEGMENT + 1)
    with pytest.raises(ValueError):
        signal_sweep.evaluate(bars(spark, wave(3)), [{"strategy": "none"}])


def test_candidates_of_all_parameters():
    base = {k: v for k, v in signal_sweep.USUAL.items() if k in sweep.SPACE}
    assert len(sweep.SPACE) == 15 and set(base) == set(sweep.SPACE)
    sets = sweep.candidates(base, trials=40, seed="x")
    assert len(sets) == 40 and sets[0] == base and sets == sweep.candidates(base, trials=40, seed="x")
    assert all(s["fast_len"] < s["slow_len"] and s["macd_fast"] < s["macd_slow"] for s in sets)
    assert all(sweep.SPACE[k][0] <= v <= sweep.SPACE[k][1] for s in sets for k, v in s.items())
    assert {round(s["rsi_level"] % 1, 9) for s in sets} == {0}


def test_every_candidate_is_evaluated(spark):
    base = {k: v for k, v in signal_sweep.USUAL.items() if k in sweep.SPACE}
    sets = [s | {"strategy": "ma_cross", "fast_len": 2 + i % 3, "slow_len": 7 + i % 2} for i, s in enumerate(sweep.candidates(base, trials=6, seed="y"))]
    got = signal_sweep.evaluate(bars(spark, wave(400)), sets)
    assert {r.param_id for r in got.where("split = 'full'").collect()} == set(range(6))
