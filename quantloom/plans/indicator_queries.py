"""Queries over bars, indicators, patterns and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.folds import fold
from quantloom.functions.scan import recursive
from quantloom.operators import indicators as I
from quantloom.operators import patterns as P
from quantloom.operators import signals as S
from quantloom.plans.base import BB, EVENT_BARS, ORDER_BARS, SHOWN, W, frame, register, rolled, s6, show
from quantloom.sources.bars import event_bars, order_bars, part_bars, resample, violations

PRICE_SQL = ", ".join(s6(c) for c in ("open", "high", "low", "close", "volume"))


@register(f"WITH {EVENT_BARS} SELECT {SHOWN}, {PRICE_SQL} FROM bars")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(event_bars(spark, sf_dir), [], ["open", "high", "low", "close", "volume"])


@register(f"WITH {ORDER_BARS} SELECT {SHOWN}, {PRICE_SQL} FROM bars")
def bars_daily_orders(spark, sf_dir):
    return show(order_bars(spark, sf_dir), [], ["open", "high", "low", "close", "volume"])


@register(f"""SELECT l_partkey::VARCHAR AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP::VARCHAR AS open_dt, {s6("arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber))", "open")},
  {s6("max(l_extendedprice)", "high")}, {s6("min(l_extendedprice)", "low")}, {s6("arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber))", "close")}, {s6("count(*)::DOUBLE", "volume")}
  FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_partkey, date_trunc('week', l_shipdate)""")
def bars_weekly_parts(spark, sf_dir):
    return show(part_bars(spark, sf_dir), [], ["open", "high", "low", "close", "volume"])


@register(f"""WITH {EVENT_BARS} SELECT symbol, time_bucket(INTERVAL 4 HOUR, open_dt)::TIMESTAMP::VARCHAR AS open_dt, {s6("arg_min(open, open_dt)", "open")}, {s6("max(high)", "high")},
  {s6("min(low)", "low")}, {s6("arg_max(close, open_dt)", "close")}, {s6("sum(volume)", "volume")} FROM bars GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, open_dt)""")
def resample_4h(spark, sf_dir):
    return show(resample(event_bars(spark, sf_dir), "4 hours", "4h"), [], ["open", "high", "low", "close", "volume"])


#: Prices spoiled by the hour, so that every kind of fault is there.
_SPOILED = {
    "high": "CASE WHEN hour(open_dt) % 8 = 1 THEN low - 1 ELSE high END", "open": "CASE hour(open_dt) % 8 WHEN 3 THEN high + 1 WHEN 6 THEN CAST('NaN' AS DOUBLE) ELSE open END",
    "close": "CASE hour(open_dt) % 8 WHEN 5 THEN low - 1 WHEN 7 THEN NULL WHEN 2 THEN CAST('Infinity' AS DOUBLE) ELSE close END",
}


@register(f"""WITH {EVENT_BARS}, f AS (SELECT symbol, open_dt, low, {", ".join(f"{c} AS {n}" for n, c in _SPOILED.items())} FROM bars),
v AS (SELECT symbol, CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR NOT isfinite(open) OR NOT isfinite(close) THEN 'not finite' WHEN high < low THEN 'high under low'
  WHEN open NOT BETWEEN low AND high THEN 'open outside' WHEN close NOT BETWEEN low AND high THEN 'close outside' END AS violation FROM f)
SELECT symbol, violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY ALL""")
def bar_violations(spark, sf_dir):
    """Bars that cannot be, by kind, among bars of which some were spoiled."""
    bars = event_bars(spark, sf_dir)
    spoiled = bars.select("symbol", "interval", "open_dt", "low", "volume", *[F.expr(c).alias(n) for n, c in _SPOILED.items()])
    return violations(spoiled).groupBy("symbol", "violation").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {EVENT_BARS} SELECT {SHOWN}, " + ", ".join(s6(rolled("avg", "close", n), f"sma_{n}") for n in (5, 20, 50, 200)) + " FROM bars")
def moving_averages(spark, sf_dir):
    return show(I.moving_averages(event_bars(spark, sf_dir)), [], ["sma_5", "sma_20", "sma_50", "sma_200"])


@register(f"WITH {EVENT_BARS}, {BB} SELECT {SHOWN}, t_low AS touch_lower, t_mid AS touch_mid, t_up AS touch_upper, {s6('mid', 'bb_mid')}, {s6('up', 'bb_up')}, {s6('dn', 'bb_low')} FROM bb")
def bollinger_bands(spark, sf_dir):
    return show(I.band_touches(I.bollinger(event_bars(spark, sf_dir))), ["touch_lower", "touch_mid", "touch_upper"], ["bb_mid", "bb_up", "bb_low"])


CUTLER = f"""dl AS (SELECT *, coalesce(close - lag(close) OVER ({W}), 0) AS delta FROM bars),
gl AS (SELECT *, greatest(delta, 0) AS gain, greatest(-delta, 0) AS loss FROM dl),
cu AS (SELECT *, CASE WHEN dn_ > 0 THEN 100 - 100 / (1 + up_ / dn_) WHEN up_ > 0 THEN 100.0 END AS rsi_sma FROM (SELECT *, {rolled('avg', 'gain', 14)} AS up_, {rolled('avg', 'loss', 14)} AS dn_ FROM gl))"""


@register(f"WITH {EVENT_BARS}, {CUTLER} SELECT {SHOWN}, {s6('rsi_sma')} FROM cu")
def rsi_cutler_14(spark, sf_dir):
    return show(I.rsi_cutler(event_bars(spark, sf_dir)), [], ["rsi_sma"])


TR = f"""tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER ({W}) AS pc FROM bars))"""


@register(f"WITH {EVENT_BARS}, {TR} SELECT {SHOWN}, {s6('tr')}, {s6('atr_sma')}, {s6('CASE WHEN close <> 0 THEN atr_sma / close * 100 END', 'atr_pct')} FROM (SELECT *, {rolled('avg', 'tr', 14)} AS atr_sma FROM tr)")
def atr_mean_14(spark, sf_dir):
    return show(I.atr_mean(event_bars(spark, sf_dir)), [], ["tr", "atr_sma", "atr_pct"])


@register(f"""WITH {EVENT_BARS}, f AS (SELECT *, CASE WHEN hh - ll <> 0 THEN 100 * (close - ll) / (hh - ll) END AS fast FROM (SELECT *, {rolled('min', 'low', 14)} AS ll, {rolled('max', 'high', 14)} AS hh FROM bars)),
k AS (SELECT *, {rolled('avg', 'fast', 3)} AS stoch_k FROM f) SELECT {SHOWN}, {s6('stoch_k')}, {s6(rolled('avg', 'stoch_k', 3), 'stoch_d')} FROM k""")
def slow_stochastic(spark, sf_dir):
    return show(I.slow_stochastic(event_bars(spark, sf_dir)), [], ["stoch_k", "stoch_d"])


@register(f"""WITH {EVENT_BARS}, t AS (SELECT *, (high + low + close) / 3 * volume AS tpv FROM bars)
SELECT {SHOWN}, {s6(f"CASE WHEN count(tpv) {frame(-19, 0)} = 20 THEN sum(tpv) {frame(-19, 0)} / (sum(volume) {frame(-19, 0)} + 1e-10) END", "vwap")} FROM t""")
def vwap_20(spark, sf_dir):
    return show(I.vwap(event_bars(spark, sf_dir)), [], ["vwap"])


@register(f"""WITH {EVENT_BARS} SELECT {SHOWN}, coalesce(volume > 2 * {rolled('avg', 'volume', 20)}, false) AS vol_spike, {s6(f"CASE WHEN rn > 20 THEN max(high) {frame(-20, -1)} END", "donch_high")},
{s6(f"CASE WHEN rn > 20 THEN min(low) {frame(-20, -1)} END", "donch_low")}, {s6(f"CASE WHEN {rolled('avg', 'close', 20)} <> 0 THEN close / {rolled('avg', 'close', 20)} * 100 END", "disparity")},
{s6(f"(volume / nullif(lag(volume) OVER ({W}), 0) - 1) * 100", "vol_change")} FROM bars""")
def channels_and_volume(spark, sf_dir):
    return show(I.disparity(I.volume_spike(I.donchian(event_bars(spark, sf_dir)))), ["vol_spike"], ["donch_high", "donch_low", "disparity", "vol_change"])


@register(f"""WITH {EVENT_BARS}, x AS (SELECT *, close / nullif(lag(close) OVER ({W}), 0) - 1 AS ret, close / nullif(open, 0) - 1 AS can FROM bars)
SELECT symbol, count(*) AS n_bars, count(*) FILTER (close > open) AS n_up, count(*) FILTER (close < open) AS n_down, {s6('avg(can)', 'mean_candle')}, {s6('avg(ret)', 'mean_return')},
{s6('arg_max(close, open_dt) / nullif(arg_min(open, open_dt), 0) - 1', 'total_return')}, {s6('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)', 'sharpe')} FROM x GROUP BY symbol""")
def series_returns(spark, sf_dir):
    return show(I.series_returns(event_bars(spark, sf_dir)), ["n_bars", "n_up", "n_down"], ["mean_candle", "mean_return", "total_return", "sharpe"], [])


# One recursion carries every exponential state from bar to bar.
def _ema(name: str, span: int, value: str) -> str:
    return f"{2 / (span + 1)!r}::DOUBLE * {value} + {1 - 2 / (span + 1)!r}::DOUBLE * r.{name} AS {name}"


def _rma(name: str, n: int, value: str) -> str:
    return f"CASE WHEN r.{name} IS NULL THEN {value} ELSE {value} / {n} + r.{name} * {n - 1} / {n} END AS {name}"


MOVES = f"""mv AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS dmp, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dmm
  FROM (SELECT *, lag(close) OVER ({W}) AS pc, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl FROM bars))"""
STATES = f"""RECURSIVE {EVENT_BARS}, {MOVES}, r AS (
  SELECT symbol, rn, close AS e12, close AS e26, close AS e200, 0.0::DOUBLE AS sig, NULL::DOUBLE AS up, NULL::DOUBLE AS dn, tr AS a14, tr AS a20, dmp AS p, dmm AS m FROM mv WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, {_ema('e12', 12, 'b.close')}, {_ema('e26', 26, 'b.close')}, {_ema('e200', 200, 'b.close')},
         0.2::DOUBLE * ({2 / 13!r}::DOUBLE * b.close + {1 - 2 / 13!r}::DOUBLE * r.e12 - ({2 / 27!r}::DOUBLE * b.close + {1 - 2 / 27!r}::DOUBLE * r.e26)) + 0.8::DOUBLE * r.sig AS sig,
         {_rma('up', 14, 'b.gain')}, {_rma('dn', 14, 'b.loss')}, {_rma('a14', 14, 'b.tr')}, {_rma('a20', 20, 'b.tr')}, {_rma('p', 14, 'b.dmp')}, {_rma('m', 14, 'b.dmm')}
  FROM r JOIN mv b ON b.symbol = r.symbol AND b.rn = r.rn + 1),
st AS (SELECT b.*, e12, e26, e200, e12 - e26 AS macd, sig, CASE WHEN rn >= 14 THEN a14 END AS atr14, CASE WHEN rn >= 20 THEN a20 END AS atr20,
  CASE WHEN rn >= 15 THEN CASE WHEN up = 0 THEN 0.0 WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END END AS rsi, CASE WHEN rn >= 14 AND p + m <> 0 AND a14 <> 0 THEN 100 * abs(p - m) / (p + m) END AS dx
  FROM r JOIN bars b USING (symbol, rn)),
d AS (SELECT symbol, rn, dx AS adx FROM st WHERE rn = 14 UNION ALL SELECT st.symbol, st.rn, coalesce(st.dx / 14 + d.adx * 13 / 14, st.dx) FROM d JOIN st ON st.symbol = d.symbol AND st.rn = d.rn + 1),
sx AS (SELECT st.*, CASE WHEN d.rn >= 27 THEN d.adx END AS adx FROM st LEFT JOIN d USING (symbol, rn))"""


@register(f"WITH {STATES} SELECT {SHOWN}, {s6('e12', 'ema_12')}, {s6('e200', 'ema_200')}, {s6('macd')}, {s6('sig', 'macd_signal')}, {s6('macd - sig', 'macd_hist')} FROM sx")
def ema_macd(spark, sf_dir):
    return show(recursive(event_bars(spark, sf_dir), ["ema_12", "ema_200", "macd"]), [], ["ema_12", "ema_200", "macd", "macd_signal", "macd_hist"])


@register(f"WITH {STATES} SELECT {SHOWN}, {s6('rsi', 'rsi_14')}, {s6('atr14', 'atr_14')}, {s6('atr20', 'atr_20')}, {s6('adx', 'adx_14')} FROM sx")
def wilder(spark, sf_dir):
    return show(recursive(event_bars(spark, sf_dir), ["rsi_14", "atr_14", "atr_20", "adx_14"]), [], ["rsi_14", "atr_14", "atr_20", "adx_14"])


@register(f"""WITH {STATES}, k AS (SELECT *, {rolled('avg', 'f', 3)} AS k FROM (SELECT *, 100 * (rsi - lo) / (hi - lo + 1e-10) AS f FROM (SELECT *, {rolled('min', 'rsi', 14)} AS lo, {rolled('max', 'rsi', 14)} AS hi FROM st)))
SELECT {SHOWN}, {s6('k', 'stoch_rsi_k')}, {s6(rolled('avg', 'k', 3), 'stoch_rsi_d')} FROM k""")
def stochastic_rsi(spark, sf_dir):
    return show(recursive(event_bars(spark, sf_dir), ["stoch_rsi"]), [], ["stoch_rsi_k", "stoch_rsi_d"])


SUPERTREND = f"""{TR}, a AS (SELECT symbol, rn, tr AS a FROM tr WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, b.tr / 10 + a.a * 9 / 10 FROM a JOIN tr b ON b.symbol = a.symbol AND b.rn = a.rn + 1),
bd AS (SELECT tr.*, (high + low) / 2 + 3 * a AS ub, (high + low) / 2 - 3 * a AS lb FROM tr JOIN a USING (symbol, rn)),
s AS (SELECT symbol, rn, close, ub AS u, lb AS l, true AS onu FROM bd WHERE rn = 10
  UNION ALL
  SELECT symbol, rn, close, u, l, CASE WHEN onu THEN close <= u ELSE close < l END FROM (
    SELECT b.symbol, b.rn, b.close, CASE WHEN b.ub < s.u OR s.close > s.u THEN b.ub ELSE s.u END AS u, CASE WHEN b.lb > s.l OR s.close < s.l THEN b.lb ELSE s.l END AS l, s.onu
    FROM s JOIN bd b ON b.symbol = s.symbol AND b.rn = s.rn + 1))"""


@register(f"""WITH RECURSIVE {EVENT_BARS}, {SUPERTREND}
SELECT b.symbol, b.open_dt::VARCHAR AS open_dt, (CASE WHEN b.close > CASE WHEN onu THEN u ELSE l END THEN 1 ELSE -1 END)::BIGINT AS supertrend_dir, {s6('CASE WHEN onu THEN u ELSE l END', 'supertrend')} FROM bars b LEFT JOIN s USING (symbol, rn)""")
def supertrend(spark, sf_dir):
    return show(fold(event_bars(spark, sf_dir), ["supertrend"]), ["supertrend_dir"], ["supertrend"])


@register(f"""WITH RECURSIVE {EVENT_BARS}, dy AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM (SELECT symbol, open_dt::DATE AS day, arg_max(close, open_dt) AS c FROM bars GROUP BY ALL)),
e AS (SELECT symbol, n, c AS e FROM dy WHERE n = 1 UNION ALL SELECT b.symbol, b.n, {2 / 201!r}::DOUBLE * b.c + {1 - 2 / 201!r}::DOUBLE * e.e FROM e JOIN dy b ON b.symbol = e.symbol AND b.n = e.n + 1)
SELECT {SHOWN}, {s6('e', 'daily_ema')} FROM bars JOIN dy ON dy.symbol = bars.symbol AND dy.day = open_dt::DATE JOIN e ON e.symbol = dy.symbol AND e.n = dy.n""".replace(SHOWN, "bars.symbol, open_dt::VARCHAR AS open_dt"))
def daily_ema_200(spark, sf_dir):
    return show(I.daily_ema(event_bars(spark, sf_dir)), [], ["daily_ema"])


SIG = ["connors", "squeeze", "turtle", "mean_reversion", "rsi", "ma_cross", "bb_breakout", "engulfing"]
FRAME = f"""fr AS (SELECT *, mid + 2 * sd AS up_, mid - 2 * sd AS dn_, coalesce(mid + 2 * sd < mid + 1.5 * atr20 AND mid - 2 * sd > mid - 1.5 * atr20, false) AS sqz FROM (
  SELECT *, {rolled('avg', 'close', 20)} AS mid, {rolled('stddev_samp', 'close', 20)} AS sd, {rolled('avg', 'close', 20)} AS s1, {rolled('avg', 'close', 60)} AS s2, {rolled('avg', 'close', 100)} AS main,
  CASE WHEN rn > 20 THEN max(high) {frame(-20, -1)} END AS dh, CASE WHEN rn > 20 THEN min(low) {frame(-20, -1)} END AS dlw FROM sx)),
lg AS (SELECT *, lag(sqz) OVER ({W}) AS psqz, lag(s1) OVER ({W}) AS ps1, lag(s2) OVER ({W}) AS ps2, lag(close) OVER ({W}) AS pcl, lag(open) OVER ({W}) AS pop, lag(up_) OVER ({W}) AS pup, lag(dn_) OVER ({W}) AS pdn FROM fr),
sg AS (SELECT *, close > main AND rsi < 30 AS connors_long, close < main AND rsi > 70 AS connors_short, psqz AND NOT sqz AND close > mid AS squeeze_long, psqz AND NOT sqz AND close < mid AS squeeze_short,
  close > dh AND close > main AS turtle_long, close < dlw AND close < main AS turtle_short, close > main AND close < dn_ AND rsi < 30 AS mean_reversion_long, close < main AND close > up_ AND rsi > 70 AS mean_reversion_short,
  rsi < 30 AS rsi_long, rsi > 70 AS rsi_short, s1 > s2 AND ps1 <= ps2 AS ma_cross_long, s1 < s2 AND ps1 >= ps2 AS ma_cross_short, close > up_ AND pcl <= pup AS bb_breakout_long, close < dn_ AND pcl >= pdn AS bb_breakout_short,
  pcl < pop AND close > open AND open <= pcl AND close >= pop AS engulfing_long, pcl > pop AND close < open AND open >= pcl AND close <= pop AS engulfing_short,
  CASE WHEN adx >= 25 AND close > main THEN 'Bull' WHEN adx >= 25 AND close <= main THEN 'Bear' ELSE 'Sideways' END AS regime FROM lg)"""
BOTH = [f"{s}_{d}" for s in SIG for d in ("long", "short")]


@register(f"WITH {STATES}, {FRAME} SELECT {SHOWN}, regime, sqz AS squeeze_on, " + ", ".join(f"coalesce({c}, false) AS {c}" for c in BOTH) + " FROM sg")
def strategy_signals(spark, sf_dir):
    return show(S.strategy_signals(I.strategy_frame(event_bars(spark, sf_dir), main=100), main="sma_100"), ["regime", "squeeze_on", *BOTH], [])


_HYBRID = f"""hy AS (SELECT *, coalesce(s20 > s50 AND adx > 25, false) AS sma_adx_strong, coalesce(macd - sig > 0 AND rsi > 55 AND close > s200, false) AS macd_rsi_trend, coalesce(close > s200, false) AS pure_trend,
CASE WHEN close <> 0 THEN atr14 / close * 100 END AS atr_pct FROM (SELECT *, {rolled('avg', 'close', 20)} AS s20, {rolled('avg', 'close', 50)} AS s50, {rolled('avg', 'close', 200)} AS s200 FROM sx))"""


@register(f"WITH {STATES}, {_HYBRID} SELECT {SHOWN}, sma_adx_strong, macd_rsi_trend, pure_trend, {s6('atr_pct')} FROM hy")
def hybrid_signals(spark, sf_dir):
    return show(S.hybrid_signals(I.live_frame(event_bars(spark, sf_dir))), ["sma_adx_strong", "macd_rsi_trend", "pure_trend"], ["atr_pct"])


@register(f"WITH {STATES}, {_HYBRID} " + " UNION ALL ".join(
    f"SELECT symbol, '{x}' AS strategy, count(*) FILTER ({x}) AS signals, {s6(f'count(*) FILTER ({x}) / count(*)::DOUBLE * 100', 'signal_rate')}, {s6(f'avg(rsi) FILTER ({x})', 'avg_rsi')}, {s6(f'avg(adx) FILTER ({x})', 'avg_adx')} FROM hy GROUP BY symbol HAVING count(*) FILTER ({x}) > 0"
    for x in ("sma_adx_strong", "macd_rsi_trend", "pure_trend")))
def hybrid_report(spark, sf_dir):
    """How often each hybrid strategy signals, and the usual RSI and ADX then."""
    return show(S.hybrid_report(I.live_frame(event_bars(spark, sf_dir))), ["strategy", "signals"], ["signal_rate", "avg_rsi", "avg_adx"], [])


CANDLES = f"""cd AS (SELECT *, close > open AS g, close < open AS r, greatest(open, close) AS bt, least(open, close) AS bb, CASE WHEN close = open THEN 1e-8 ELSE abs(close - open) END AS body,
  CASE WHEN high = low THEN 1e-8 ELSE high - low END AS rng FROM bars),
ca AS (SELECT *, high - bt AS uw, bb - low AS lw, body / rng AS rel FROM cd),
cl AS (SELECT *, {", ".join(f"lag({c}, {k}) OVER ({W}) AS {c}{k}" for c in ("g", "r", "bt", "bb", "open", "close", "rel") for k in (1, 2))} FROM ca)"""
PATTERN_SQL = {
    "bullish_engulfing": "r1 AND g AND bt >= bt1 AND bb <= bb1", "bearish_engulfing": "g1 AND r AND bt >= bt1 AND bb <= bb1", "bullish_harami": "r1 AND g AND bt <= bt1 AND bb >= bb1",
    "bearish_harami": "g1 AND r AND bt <= bt1 AND bb >= bb1", "three_inside_up": "r2 AND g1 AND bt1 <= bt2 AND bb1 >= bb2 AND g AND close > close1", "hammer": "g AND lw >= 2 * body AND uw <= 0.5 * body",
    "hanging_man": "rel <= 0.4 AND lw >= 2 * body AND uw <= 0.5 * body", "doji": "rel <= 0.1", "morning_star": "r2 AND rel1 <= 0.4 AND g AND close >= (open2 + close2) / 2",
    "evening_star": "g2 AND rel1 <= 0.4 AND r AND close <= (open2 + close2) / 2", "three_white_soldiers": "g AND g1 AND g2 AND close > close1 AND close1 > close2",
    "three_black_crows": "r AND r1 AND r2 AND close < close1 AND close1 < close2", "shooting_star": "rel <= 0.4 AND uw >= 2 * body AND lw <= 0.5 * body",
}


@register(f"WITH {EVENT_BARS}, {CANDLES} SELECT {SHOWN}, " + ", ".join(f"coalesce({c}, false) AS {n}" for n, c in PATTERN_SQL.items()) + " FROM cl")
def candle_patterns(spark, sf_dir):
    return show(P.patterns(event_bars(spark, sf_dir)), list(PATTERN_SQL), [])


@register(f"""WITH {EVENT_BARS} SELECT {SHOWN} FROM (SELECT *, lag(close - open, 1) OVER ({W}) AS d1, lag(close - open, 2) OVER ({W}) AS d2, lag(close - open, 3) OVER ({W}) AS d3 FROM bars)
WHERE d3 > 0 AND d2 > 0 AND d1 < 0 AND close - open > 0""")
def sequence_match(spark, sf_dir):
    return show(P.sequence_match(event_bars(spark, sf_dir), [1, 1, -1, 1]).where("matched"), [], [])


@register(f"""WITH {STATES}, rs AS (SELECT *, 100 * (rsi - {rolled('min', 'rsi', 14)}) / ({rolled('max', 'rsi', 14)} - {rolled('min', 'rsi', 14)} + 1e-10) AS f FROM st),
x AS (SELECT *, {", ".join(f"CASE WHEN {rolled('max', 'high', n)} - {rolled('min', 'low', n)} <> 0 THEN 100 * (close - {rolled('min', 'low', n)}) / ({rolled('max', 'high', n)} - {rolled('min', 'low', n)}) END AS f{n}" for n in (5, 10, 20))},
  {rolled('avg', 'f', 3)} AS rk, CASE WHEN rn >= 20 THEN sum((high + low + close) / 3 * volume) {frame(-19, 0)} / (sum(volume) {frame(-19, 0)} + 1e-10) END AS vw FROM rs),
y AS (SELECT *, {", ".join(f"{rolled('avg', f'f{n}', k)} AS k{n}" for n, k in ((5, 3), (10, 6), (20, 12)))}, {rolled('avg', 'rk', 3)} AS rd FROM x),
z AS (SELECT *, {", ".join(f"{rolled('avg', f'k{n}', k)} AS d{n}" for n, k in ((5, 3), (10, 6), (20, 12)))} FROM y),
{SUPERTREND}, v AS (SELECT z.symbol, z.open_dt, (coalesce(sign(k5 - d5), 0) + coalesce(sign(k10 - d10), 0) + coalesce(sign(k20 - d20), 0) + coalesce(sign(rk - rd), 0) + coalesce(sign(z.close - vw), 0)
  + CASE WHEN z.close > CASE WHEN s.onu THEN s.u ELSE s.l END THEN 1 ELSE -1 END)::BIGINT AS votes FROM z LEFT JOIN s USING (symbol, rn))
SELECT {SHOWN}, votes, CASE WHEN votes >= 2 THEN 'bullish' WHEN votes <= -2 THEN 'bearish' ELSE 'neutral' END AS bias FROM v""")
def trend_votes(spark, sf_dir):
    return show(S.trend_votes(I.trend_frame(event_bars(spark, sf_dir))), ["votes", "bias"], [])
