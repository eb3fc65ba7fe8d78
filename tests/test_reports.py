"""Small pieces of reports: frames by mode, templates, fallbacks, flags."""

from __future__ import annotations

import json

import pytest
from helpers import bars, wave

from pyspark.sql import functions as F

from quantloom.functions.stats import P_FLOOR
from quantloom.operators import complex_study as X
from quantloom.operators import indicators as I
from quantloom.operators import scan as C
from quantloom.operators import streak as K
from quantloom.sources.metadata import explained, read_strategies


def test_frames_by_mode(spark):
    df = bars(spark, wave(60))
    back, trend, live = (set(I.frame_for(df, m).columns) for m in ("backtest", "trend", "live"))
    assert back < trend and {"supertrend", "stoch_20_12_12_k", "regime"} <= trend and "atr_pct" in live
    assert {"is_green", "body_pct", "rsi_sma", "atr_pct", "disparity", "vol_change"} <= set(I.streak_frame(df).columns)
    with pytest.raises(ValueError):
        I.frame_for(df, "other")


def test_vwap_without_volume(spark):
    df = bars(spark, wave(25))
    out = I.vwap(df.drop("volume")).withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3).toPandas()
    assert out["vwap"].isna().sum() == 19 and out["vwap"].iloc[-1] == pytest.approx(out["tp"].iloc[-20:].mean())


def test_floored_p_is_flagged(spark):
    got = {r.k: (r.p_value, r.p_floored) for r in K.with_odds(spark.createDataFrame([(0, 200), (100, 200), (0, 0)], "k long, n long")).collect() if r.n}
    assert got[0] == (P_FLOOR, True) and got[100] == (1.0, False)


def test_templates_are_filled_in(spark, tmp_path):
    texts = {"A": {"en": {"concept": "c {rsi_ob}", "long": "below {rsi_os}, above {sma_main_len}", "short": "above {rsi_ob} and {sma1_len}/{sma2_len}"}, "ko": {"long": "x"}}}
    (tmp_path / "s.json").write_text(json.dumps(texts, indent=1))
    got = {(r.strategy, r.lang): r[2:] for r in explained(read_strategies(spark, str(tmp_path / "s.json")), rsi_ob=75, sma_main_len=100).collect()}
    assert got == {("A", "en"): ("c {rsi_ob}", "below 25, above 100", "above 75 and 20/60", ""), ("A", "ko"): ("", "x", "", "")}


def test_follow_ups_count_a_doji_as_red_and_need_a_next_bar(spark):
    up, down, flat = (10, 12, 9, 11), (11, 12, 9, 10), (10, 11, 9, 10)
    rows = [up, up, down, flat, up, up, up, down, up, up, up, down]
    df = bars(spark, rows).withColumns({"rsi_sma": F.lit(None).cast("double"), "matched": F.col("close") < F.col("open")})
    got = [(r.open_dt.hour, r.c1_color, r.c2_color, r.c1_success, r.rsi) for r in X.follow_ups(df, "matched", 2, 1).orderBy("open_dt").collect()]
    assert got == [(2, "red", "green", False, 50.0), (7, "green", "green", True, 50.0)]


def test_live_rules_need_a_closed_bar(spark):
    assert C.hybrid_live(bars(spark, wave(1))).count() == 0
    got = C.hybrid_live(bars(spark, wave(5))).collect()
    assert len(got) == 6 and not any(r.is_active for r in got) and all(r.holds is None for r in got if "sma_200" in r.part)


def test_tail_has_the_columns_that_exist(spark):
    df = bars(spark, wave(9)).union(bars(spark, wave(2), "Y"))
    out = C.tail(df, ["close", "absent", "open_dt", "volume", "close"], 3)
    assert out.columns == ["symbol", "interval", "open_dt", "close", "volume"]
    assert sorted((r.symbol, r.open_dt.hour) for r in out.collect()) == [("X", 6), ("X", 7), ("X", 8), ("Y", 0), ("Y", 1)]
