"""Hand-made scenarios of the back-tests and of what is said about trades."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import START, bars, wave

from pyspark.sql import functions as F

from quantloom.operators import backtest as B
from quantloom.operators import sweep


def _run(spark, rows, **rules):
    df = bars(spark, [(*r, 1.0, i == 0, "Bull") for i, r in enumerate(rows)], extra="sig boolean, regime string")
    return B.run(df, "sig", B.Rules(**{"leverage": 1, "fee": 0.0, **rules})).collect()


def test_enters_at_the_next_open_and_takes_profit(spark):
    (t,) = _run(spark, [(99, 101, 98, 100), (100, 103, 99.5, 102), (102, 103, 101, 102), (102, 103, 101, 102)])
    assert (t.entry_price, t.outcome, t.entry_dt) == (100, "TP", START + dt.timedelta(hours=1))
    assert t.pnl == pytest.approx(0.02)


def test_liquidation_comes_first(spark):
    (t,) = _run(spark, [(99, 101, 98, 100), (100, 103, 40, 102), (102, 103, 101, 102), (102, 103, 101, 102)], leverage=2)
    assert (t.outcome, t.pnl, t.exit_price) == ("Liquidation", -1.0, 50.0)


def test_short_takes_profit(spark):
    (t,) = _run(spark, [(99, 101, 98, 100), (100, 100.5, 97, 98), (98, 99, 97, 98), (98, 99, 97, 98)], direction="short")
    assert t.outcome == "TP" and t.pnl == pytest.approx(0.02)


def test_stop_before_target_in_one_bar(spark):
    (t,) = _run(spark, [(99, 101, 98, 100), (100, 103, 98, 102), (102, 103, 101, 102)])
    assert t.outcome == "SL"


def test_time_out_at_the_close(spark):
    (t,) = _run(spark, [(99, 101, 98, 100), (100, 101, 99, 100), (100, 102, 99, 101.5), (101, 102, 99, 100)], take_profit=0.5, stop_loss=0.5, max_bars=1)
    assert (t.outcome, t.exit_price) == ("TimeOut", 101.5) and t.pnl == pytest.approx(0.015)


def test_no_entry_on_the_last_bar(spark):
    assert _run(spark, [(99, 101, 98, 100), (100, 103, 99, 102)]) == []


def test_rules_are_checked():
    with pytest.raises(ValueError):
        B.Rules(leverage=500)
    with pytest.raises(ValueError):
        B.Rules(direction="up")


def _trades(spark, pnls):
    rows = [("X", "1h", START + dt.timedelta(hours=i), START + dt.timedelta(hours=i + 1), p, "TP") for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "symbol string, interval string, signal_dt timestamp_ntz, entry_dt timestamp_ntz, pnl double, outcome string")


def test_summary_adds_and_compounds(spark):
    s = B.summary(_trades(spark, [0.10, -0.05, 0.02])).first()
    assert s.total_pnl == pytest.approx(7.0) and s.compounded_pnl == pytest.approx((1.1 * 0.95 * 1.02 - 1) * 100) and s.n_trades == 3


def test_drawdown_and_runs_of_losses(spark):
    d = B.drawdowns(_trades(spark, [0.1, -0.2, -0.1, 0.3, -0.1])).first()
    assert d.max_dd == pytest.approx(0.3) and d.max_losses == 2


def test_monte_carlo_is_repeatable_and_needs_trades(spark):
    few = _trades(spark, [0.1, 0.2])
    assert B.monte_carlo(few, 20).count() == 0
    many = _trades(spark, [0.1, -0.2, 0.05, 0.3, -0.1, 0.02])
    a, b = (B.monte_carlo(x, 50).first() for x in (many, many.repartition(3)))
    assert a == b and a.runs == 50 and a.mean_final_pnl == pytest.approx(17.0)


def test_one_trade_at_a_time(spark):
    rows = [(100, 101, 89, 90, 1.0), (90, 93, 89, 92, 1.0), (92, 96, 91, 95, 1.0), (95, 96, 80, 82, 1.0), (82, 84, 81, 83, 1.0), (83, 84, 82, 83, 1.0)]
    df = bars(spark, rows).withColumns({"rsi_sma": F.lit(10.0), "uptrend": F.lit(True)})
    got = B.run_one_at_a_time(df, take_profit=5.0, stop_loss=5.0, pullback=5.0).collect()
    assert [(t.entry_price, t.reason) for t in got] == [(90.0, "TP")]  # the second entry is still open at the end


def test_splits_by_position(spark):
    got = B.splits(bars(spark, wave(10)), 0.7).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 7, "test": 3}


def test_candidates_start_with_the_base():
    base = {"take_profit": 2.0, "stop_loss": 1.0, "max_hold": 48}
    sets = sweep.candidates(base, 10)
    assert sets[0] == base and len(sets) == 10 and sets == sweep.candidates(base, 10)


def test_sweep_equals_single_runs(spark):
    df = bars(spark, wave(60)).withColumn("sig", F.col("close") > F.col("open"))
    sets = [{"take_profit": 1.0, "stop_loss": 0.5, "max_hold": 4}, {"take_profit": 2.0, "stop_loss": 1.0, "max_hold": 6}]
    got = {r.param_id: (r.n_trades, round(r.total_pnl, 9)) for r in sweep.evaluate(df, "sig", sets, train=0.0).collect()}
    for i, s in enumerate(sets):
        alone = B.run_at_close(df, "sig", s["take_profit"], s["stop_loss"], s["max_hold"]).agg(F.count("*"), F.round(F.sum("pnl"), 9)).first()
        assert got[i] == (alone[0], pytest.approx(alone[1]))


def test_parameter_effects(spark):
    rows = [(i, float(i), float(i * 2), 3.0) for i in range(12)]
    trials = spark.createDataFrame(rows, "param_id int, score double, a double, b double")
    got = sweep.parameter_effects(trials, ["a", "b"]).collect()
    assert [r.parameter for r in got] == ["a"] and got[0].effect > 0
    assert sweep.parameter_effects(trials.limit(5), ["a"]).count() == 0


def test_runs_of_one_series(spark):
    """Run keys of any spelling stay apart, and the interval stays what it is."""
    df = bars(spark, wave(40), interval="1|h").withColumns({"sig": F.col("close") > F.col("open"), "regime": F.lit("r")})
    both = df.withColumn("run", F.explode(F.array(F.lit("a|b"), F.lit("a"))))
    got = B.run(both, "sig", B.Rules(max_bars=3), keep=("run",)).groupBy("interval", "run").agg(F.count("*"), F.round(F.sum("pnl"), 9)).collect()
    alone = B.run(df, "sig", B.Rules(max_bars=3)).agg(F.count("*"), F.round(F.sum("pnl"), 9)).first()
    assert sorted(got) == [("1|h", "a", *alone), ("1|h", "a|b", *alone)]


def test_sequences():
    from quantloom.operators import patterns as P

    assert P.two_segments(("green", 2), ("red", 1)) == [1, 1, -1]
    assert P.profile([1, 1, -1]) == {"rises": 2, "drops": 1, "last": -1, "expected": 1}
    with pytest.raises(ValueError):
        P.profile([1, 0])


def test_mean_interval(spark):
    from quantloom.functions.stats import with_mean_interval

    got = with_mean_interval(spark.createDataFrame([(1.0, 2.0, 10), (1.0, 0.0, 10), (1.0, None, 1), (None, None, 0)], "m double, s double, n int"), "m", "s", "n").collect()
    assert got[0].ci_upper - 1 == pytest.approx(2.2621571627 * 2 / 10**0.5) and got[1].ci_lower == 1 and got[2].ci_width == 0 and got[3].ci_lower is None


def test_bootstrap_spreads_round_the_sum_and_needs_trades(spark):
    few = B.bootstrap(_trades(spark, [0.1, 0.2, -0.1, 0.3]), 20).first()
    assert few.n_trades == 4 and few.runs == 0 and few.mean_final_pnl is None and few.best_case is None
    pnls = [0.1, -0.2, 0.05, 0.3, -0.1, 0.02, 0.07, -0.04]
    many = _trades(spark, pnls)
    a, b = (B.bootstrap(x, 400).first() for x in (many, many.repartition(3)))
    assert [round(x, 9) if isinstance(x, float) else x for x in a] == [round(x, 9) if isinstance(x, float) else x for x in b]
    sd = (sum((p - sum(pnls) / 8) ** 2 for p in pnls) / 8) ** 0.5
    assert a.mean_final_pnl == pytest.approx(sum(pnls) * 100, abs=4 * 100 * sd * 8**0.5 / 400**0.5)
    assert a.worst_case < a.ci_lower < a.mean_final_pnl < a.ci_upper < a.best_case
    assert (a.ci_upper - a.ci_lower) / 100 == pytest.approx(2 * 1.96 * sd * 8**0.5, rel=0.25)


def test_gate_by_the_higher_timeframe(spark):
    rows = [(100, 101, 89, 90, 1.0), (90, 93, 89, 92, 1.0), (92, 96, 91, 95, 1.0), (95, 96, 80, 82, 1.0)]
    df = bars(spark, rows).union(bars(spark, rows, "Y")).withColumns({"rsi_sma": F.lit(10.0), "uptrend": F.lit(True)})
    sharpes = spark.createDataFrame([("X", 0.4), ("Y", 0.0)], "symbol string, sharpe double")
    got = B.run_one_at_a_time(df, take_profit=5.0, stop_loss=5.0, pullback=5.0, sharpes=sharpes).collect()
    assert [t.symbol for t in got] == ["X"]
