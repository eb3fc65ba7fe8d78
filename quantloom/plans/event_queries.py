"""Queries of joins along time, levels, event studies and back-tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.stats import with_mean_interval, with_t_test
from quantloom.operators import backtest as B
from quantloom.operators import events as E
from quantloom.operators import indicators as I
from quantloom.operators import joins as J
from quantloom.operators import levels as L
from quantloom.operators import patterns as P
from quantloom.operators import signals as S
from quantloom.plans.base import BB, EVENT_BARS, ORDER_BARS, SHOWN, W, frame, register, rolled, s6, show, sql_t_two_sided
from quantloom.plans.indicator_queries import CANDLES, CUTLER, FRAME, PATTERN_SQL, STATES
from quantloom.sources.bars import event_bars, order_bars, resample

FOUR = f"""h4 AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, open_dt)::TIMESTAMP AS open_dt, arg_min(open, open_dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_dt) AS close FROM bars GROUP BY ALL),
hs AS (SELECT *, {rolled('avg', 'close', 5)} AS sma_5 FROM h4)"""


def _bands(spark, sf_dir):
    return I.band_touches(I.bollinger(I.moving_averages(event_bars(spark, sf_dir), (5, 20, 50))))


def _higher(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    return J.asof(I.moving_averages(bars, (5, 20)), I.moving_averages(resample(bars, "4 hours", "4h"), (5,)), ["close", "sma_5"], "4h")


@register(f"WITH {EVENT_BARS}, {FOUR} SELECT b.symbol, b.open_dt::VARCHAR AS open_dt, {s6('h.close', 'close_4h')}, {s6('h.sma_5', 'sma_5_4h')} FROM bars b ASOF LEFT JOIN hs h ON b.symbol = h.symbol AND b.open_dt >= h.open_dt")
def asof_higher_mean(spark, sf_dir):
    return show(_higher(spark, sf_dir), [], ["close_4h", "sma_5_4h"])


@register(f"""WITH {EVENT_BARS}, {FOUR}, x AS (SELECT b.*, h.sma_5 AS hi FROM bars b ASOF LEFT JOIN hs h ON b.symbol = h.symbol AND b.open_dt >= h.open_dt),
m AS (SELECT *, {rolled('avg', 'close', 5)} AS f, {rolled('avg', 'close', 20)} AS s FROM x),
c AS (SELECT *, f > s AND lag(f) OVER ({W}) <= lag(s) OVER ({W}) AS cr, coalesce(low <= hi AND hi <= high, false) AS t FROM m),
n AS (SELECT *, max(t::INT) {frame(1, 10)} AS met FROM c)
SELECT symbol, count(*) AS crosses, count(*) FILTER (met = 1) AS touched FROM n WHERE cr GROUP BY symbol""")
def cross_touches(spark, sf_dir):
    return show(E.cross_touches(_higher(spark, sf_dir), "sma_5", "sma_20", "sma_5_4h"), ["crosses", "touched"], [], [])


SWING = f"""sw AS (SELECT *, coalesce(rn > 6 AND lag(high, 3) OVER ({W}) >= max(high) {frame(-6, 0)}, false) AS sh, coalesce(rn > 6 AND lag(low, 3) OVER ({W}) <= min(low) {frame(-6, 0)}, false) AS sl,
  lag(high, 3) OVER ({W}) AS ph, lag(low, 3) OVER ({W}) AS pl FROM bars)"""


@register(f"WITH {EVENT_BARS}, {SWING} SELECT {SHOWN}, sh AS swing_high, sl AS swing_low, {s6('CASE WHEN sh THEN ph END', 'swing_high_price')}, {s6('CASE WHEN sl THEN pl END', 'swing_low_price')} FROM sw")
def swing_points(spark, sf_dir):
    return show(L.swings(event_bars(spark, sf_dir)), ["swing_high", "swing_low"], ["swing_high_price", "swing_low_price"])


@register(f"""WITH {EVENT_BARS}, {SWING}, p AS (SELECT symbol, 'resistance' AS kind, ph AS price FROM sw WHERE sh UNION ALL SELECT symbol, 'support', pl FROM sw WHERE sl),
c AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, kind ORDER BY price) AS cl FROM (
  SELECT *, CASE WHEN price - lag(price) OVER (PARTITION BY symbol, kind ORDER BY price) <= 0.003 * abs(lag(price) OVER (PARTITION BY symbol, kind ORDER BY price)) THEN 0 ELSE 1 END AS nw FROM p))
SELECT symbol, kind, 'main' AS timeframe, 'swing' AS source, count(*) AS touches, {s6('avg(price)', 'price')} FROM c GROUP BY symbol, kind, cl HAVING count(*) >= 2""")
def swing_levels(spark, sf_dir):
    return show(L.swing_levels(event_bars(spark, sf_dir)), ["kind", "timeframe", "source", "touches"], ["price"], [])


@register(f"""WITH {EVENT_BARS}, d AS (SELECT symbol, open_dt::DATE AS day, max(high) AS h, min(low) AS l, arg_max(close, open_dt) AS c FROM bars GROUP BY ALL),
t AS (SELECT *, (h + l + c) / 3 AS p FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) <= 3),
x AS (SELECT symbol, day, unnest(['P', 'R1', 'S1', 'R2', 'S2']) AS label, unnest([p, 2 * p - l, 2 * p - h, p + (h - l), p - (h - l)]) AS price FROM t)
SELECT symbol, day::TIMESTAMP::VARCHAR AS open_dt, label, {s6('price')} FROM x""")
def daily_pivots(spark, sf_dir):
    return show(L.daily_pivots(event_bars(spark, sf_dir)), ["label"], ["price"])


def _swing_rows(source: str, timeframe: str) -> str:
    """SQL of swing levels met twice or more in a bar table with rn."""
    swing = SWING.partition("AS (")[2].rpartition(")")[0].replace("FROM bars", f"FROM {source}")
    order = "OVER (PARTITION BY symbol, kind ORDER BY price)"
    return f"""SELECT symbol, kind, '{timeframe}' AS timeframe, 'swing' AS source, '' AS label, count(*) AS touches, avg(price) AS price FROM (
  SELECT *, sum(nw) OVER (PARTITION BY symbol, kind ORDER BY price) AS cl FROM (
    SELECT *, CASE WHEN price - lag(price) {order} <= 0.003 * abs(lag(price) {order}) THEN 0 ELSE 1 END AS nw FROM (
      SELECT symbol, unnest(['resistance', 'support']) AS kind, unnest([CASE WHEN sh THEN ph END, CASE WHEN sl THEN pl END]) AS price FROM ({swing})) WHERE price IS NOT NULL))
  GROUP BY symbol, kind, cl HAVING count(*) >= 2"""


@register(f"""WITH {EVENT_BARS}, {FOUR}, b4 AS (SELECT *, row_number() OVER ({W}) AS rn FROM h4), d AS (SELECT symbol, open_dt::DATE AS day, max(high) AS h, min(low) AS l, arg_max(close, open_dt) AS c FROM bars GROUP BY ALL),
t AS (SELECT *, (h + l + c) / 3 AS p FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) <= 3),
u AS ({_swing_rows('bars', 'main')} UNION ALL {_swing_rows('b4', '4H')} UNION ALL
  SELECT symbol, 'pivot', '1D', 'pivot', unnest(['P', 'R1', 'S1', 'R2', 'S2']), 1, unnest([p, 2 * p - l, 2 * p - h, p + (h - l), p - (h - l)]) FROM t)
SELECT symbol, kind, timeframe, source, label, touches, {s6('price')} FROM u""")
def level_report(spark, sf_dir):
    return show(L.level_report(event_bars(spark, sf_dir), min_touches=2), ["kind", "timeframe", "source", "label", "touches"], ["price"], [])


EVENT = f"ev AS (SELECT *, t_up AND NOT coalesce(lag(t_up) OVER ({W}), false) AS ev, lead(open_dt) OVER ({W}) AS nx FROM bb)"


@register(f"""WITH {EVENT_BARS}, {BB}, {EVENT}, m AS (SELECT *, list_position(list(t_mid::INT) {frame(1, 7)}, 1) AS hit, list(t_mid::INT) {frame(8, 12)} AS late FROM ev)
SELECT symbol, count(*) AS events, count(*) FILTER (hit > 0) AS success, {s6('avg(hit) FILTER (hit > 0)', 'mean_bars')}, count(*) FILTER (coalesce(hit, 0) = 0 AND len(late) = 5) AS failed,
{", ".join(f"count(*) FILTER (coalesce(hit, 0) = 0 AND len(late) = 5 AND list_position(late, 1) = {k}) AS late_{k}" for k in range(1, 6))} FROM m WHERE ev AND nx IS NOT NULL GROUP BY symbol""")
def band_mid_touch(spark, sf_dir):
    return show(E.mid_touch(_bands(spark, sf_dir), "upper"), ["events", "success", "failed", *[f"late_{k}" for k in range(1, 6)]], ["mean_bars"], [])


_TWO = EVENT_BARS.replace("bars AS", "b0 AS", 1) + """, bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_dt) AS rn FROM (SELECT symbol || '|1h' AS symbol, open_dt, open, high, low, close, volume FROM b0
  UNION ALL SELECT symbol || '|4h', time_bucket(INTERVAL 4 HOUR, open_dt)::TIMESTAMP AS t, arg_min(open, open_dt), max(high), min(low), arg_max(close, open_dt), sum(volume) FROM b0 GROUP BY symbol, t))"""


@register(f"""WITH {_TWO}, {BB}, {EVENT}, m AS (SELECT *, list_position(list(t_mid::INT) {frame(1, 7)}, 1) AS hit, list(t_mid::INT) {frame(8, 12)} AS late FROM ev)
SELECT symbol, count(*) AS events, count(*) FILTER (hit > 0) AS success, {s6('avg(hit) FILTER (hit > 0)', 'mean_bars')}, count(*) FILTER (coalesce(hit, 0) = 0 AND len(late) = 5) AS failed FROM m WHERE ev AND nx IS NOT NULL GROUP BY symbol""")
def band_report_intervals(spark, sf_dir):
    """The band study for several intervals in one job: an interval is a part of a series' key."""
    hourly = event_bars(spark, sf_dir)
    both = hourly.union(resample(hourly, "4 hours", "4h").select(hourly.columns))
    out = E.mid_touch(I.band_touches(I.bollinger(I.moving_averages(both, (5, 20, 50)))), side="upper")
    return show(out.withColumn("symbol", F.concat_ws("|", "symbol", "interval")), ["events", "success", "failed"], ["mean_bars"], [])


@register(f"""WITH {EVENT_BARS}, {BB}, {EVENT}, m AS (SELECT *, (max(high) {frame(1, 7)} - close) / close * 100 AS mfe, (min(low) {frame(1, 7)} - close) / close * 100 AS mae, (last_value(close) {frame(1, 7)} - close) / close * 100 AS end_ret FROM ev)
SELECT {SHOWN}, {s6('CASE WHEN close > 0 THEN mfe END', 'mfe')}, {s6('CASE WHEN close > 0 THEN mae END', 'mae')}, {s6('CASE WHEN close > 0 THEN end_ret END', 'end_ret')} FROM m WHERE ev""")
def event_excursions(spark, sf_dir):
    return show(E.excursions(E.first_touches(_bands(spark, sf_dir), "upper")).where("event"), [], ["mfe", "mae", "end_ret"])


@register(f"""WITH {EVENT_BARS}, {BB}, {EVENT}, p AS (SELECT *, CASE WHEN up - dn > 0 THEN least(1.0, greatest(0.0, (low - dn) / (up - dn))) END AS pl FROM ev), q AS (SELECT *, min(pl) {frame(1, 7)} AS x FROM p)
SELECT symbol, count(*) FILTER (x <= 0.25) AS q1, count(*) FILTER (x > 0.25 AND x <= 0.5) AS q2, count(*) FILTER (x > 0.5 AND x <= 0.75) AS q3, count(*) FILTER (x > 0.75) AS q4, count(*) AS total FROM q WHERE ev AND x IS NOT NULL GROUP BY symbol""")
def quartile_reach(spark, sf_dir):
    return show(E.quartile_reach(_bands(spark, sf_dir), "upper"), ["q1", "q2", "q3", "q4", "total"], [], [])


@register(f"""WITH {EVENT_BARS}, {BB}, f AS (SELECT *, coalesce((t_low OR t_up) AND NOT coalesce(lag(t_low OR t_up) OVER ({W}), false) AND max(t_mid::INT) {frame(1, 7)} = 1, false) AND sma5 > sma20 AS sig FROM bb),
e AS (SELECT *, lead(open) OVER ({W}) AS en, max(high) {frame(1, 6)} AS mx, last_value(close) {frame(1, 6)} AS lc FROM f)
SELECT symbol, count(*) AS events, count(*) FILTER (mx >= en * 1.01) AS tp_hits, {s6('count(*) FILTER (mx >= en * 1.01) / count(*)::DOUBLE * 100', 'hit_rate')}, {s6('avg(CASE WHEN mx >= en * 1.01 THEN 1.0 ELSE (lc - en) / en * 100 END)', 'avg_ret')}
FROM e WHERE sig AND en > 0 GROUP BY symbol""")
def combo_filter(spark, sf_dir):
    """Band reversion and mean filter together, then a target-only back-test."""
    bars = E.band_filter(_bands(spark, sf_dir), "mid_reversion")
    bars = bars.withColumn("signal", S.all_of(F.col("bb_filter"), F.col("sma_5") > F.col("sma_20")))
    return show(E.take_profit_summary(E.take_profit(bars, "signal")), ["events", "tp_hits"], ["hit_rate", "avg_ret"], [])


_SIDE = {n: ("up" if n in ("bullish_engulfing", "bullish_harami", "three_inside_up", "hammer", "doji", "morning_star", "three_white_soldiers") else "down") for n in PATTERN_SQL}


@register(f"WITH {EVENT_BARS}, {CANDLES}, fw AS (SELECT *, max(high) {frame(1, 3)} AS mu, min(low) {frame(1, 3)} AS md, count(*) {frame(1, 2)} AS lf FROM cl) " + " UNION ALL ".join(
    f"SELECT symbol, '{n}' AS pattern, count(*) FILTER (coalesce({c}, false)) AS signals, coalesce(bool_or(coalesce({c}, false) AND lf = 1), false) AS last_on, "
    + s6(f"avg(CASE WHEN {'(mu - close) / close' if _SIDE[n] == 'up' else '(close - md) / close'} >= 0.01 THEN 1.0 ELSE 0.0 END) FILTER (coalesce({c}, false)) * 100", "hit_rate")
    + " FROM fw WHERE lf > 0 GROUP BY symbol" for n, c in PATTERN_SQL.items()))
def pattern_hit_rates(spark, sf_dir):
    return show(E.pattern_hits(P.patterns(event_bars(spark, sf_dir)), list(PATTERN_SQL)), ["pattern", "signals", "last_on"], ["hit_rate"], [])


_LONG = f"b2 AS (SELECT *, {rolled('avg', 'close', 200)} AS s200 FROM bb)"


def _masked(side: str, regime: str) -> str:
    """SQL of first touches of one band above or below the long mean."""
    touch = f"coalesce(t_{side} AND close {'>' if regime == 'above_sma200' else '<'} s200, false)"
    return f"{_LONG}, mk AS (SELECT *, {touch} AS mk FROM b2), ev AS (SELECT *, mk AND NOT coalesce(lag(mk) OVER ({W}), false) AS ev, lead(open_dt) OVER ({W}) AS nx FROM mk)"


def _long_bands(bars):
    return I.band_touches(I.bollinger(I.moving_averages(bars, (5, 20, 50, 200))))


_TWO_DAILY = ORDER_BARS.replace("bars AS", "b0 AS", 1) + """, bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_dt) AS rn FROM (SELECT symbol || '|1d' AS symbol, open_dt, open, high, low, close, volume FROM b0
  UNION ALL SELECT symbol || '|3d', time_bucket(INTERVAL 3 DAY, open_dt)::TIMESTAMP AS t, arg_min(open, open_dt), max(high), min(low), arg_max(close, open_dt), sum(volume) FROM b0 GROUP BY symbol, t))"""


_HIT = f"m AS (SELECT *, list_position(list(t_mid::INT) {frame(1, 7)}, 1) AS hit, list(t_mid::INT) {frame(8, 12)} AS late FROM ev)"


@register(f"""WITH {ORDER_BARS}, {BB}, {_masked('low', 'above_sma200')}, {_HIT}
SELECT symbol, count(*) AS events, count(*) FILTER (hit > 0) AS success, {s6('avg(hit) FILTER (hit > 0)', 'mean_bars')}, count(*) FILTER (coalesce(hit, 0) = 0 AND len(late) = 5) AS failed FROM m WHERE ev AND nx IS NOT NULL GROUP BY symbol""")
def band_mid_touch_lower(spark, sf_dir):
    """First touches of the lower band above the long mean."""
    return show(E.mid_touch(_long_bands(order_bars(spark, sf_dir)), "lower", regime="above_sma200"), ["events", "success", "failed"], ["mean_bars"], [])


@register(f"""WITH {ORDER_BARS}, {BB}, {_masked('low', 'below_sma200')}, p AS (SELECT *, CASE WHEN up - dn > 0 THEN least(1.0, greatest(0.0, (high - dn) / (up - dn))) END AS pl FROM ev), q AS (SELECT *, max(pl) {frame(1, 7)} AS x FROM p)
SELECT symbol, count(*) FILTER (x <= 0.25) AS q1, count(*) FILTER (x > 0.25 AND x <= 0.5) AS q2, count(*) FILTER (x > 0.5 AND x <= 0.75) AS q3, count(*) FILTER (x > 0.75) AS q4, count(*) AS total FROM q WHERE ev AND x IS NOT NULL GROUP BY symbol""")
def quartile_reach_lower(spark, sf_dir):
    """How far prices climbed after a first touch of the lower band below the long mean."""
    return show(E.quartile_reach(_long_bands(order_bars(spark, sf_dir)), "lower", regime="below_sma200"), ["q1", "q2", "q3", "q4", "total"], [], [])


@register(f"""WITH {_TWO_DAILY}, {BB}, {_masked('low', 'above_sma200')}, {_HIT}
SELECT symbol, count(*) AS events, count(*) FILTER (hit > 0) AS success, {s6('avg(hit) FILTER (hit > 0)', 'mean_bars')} FROM m WHERE ev AND nx IS NOT NULL GROUP BY symbol""")
def band_report_lower(spark, sf_dir):
    """The lower band's study above the long mean, for several intervals in one job."""
    daily = order_bars(spark, sf_dir)
    both = daily.union(resample(daily, "3 days", "3d").select(daily.columns))
    out = E.mid_touch(_long_bands(both), "lower", regime="above_sma200")
    return show(out.withColumn("symbol", F.concat_ws("|", "symbol", "interval")), ["events", "success"], ["mean_bars"], [])


@register(f"""WITH {ORDER_BARS}, {BB}, f AS (SELECT *, t_low AND NOT coalesce(lag(t_low) OVER ({W}), false) AS a, t_up AND NOT coalesce(lag(t_up) OVER ({W}), false) AS b,
  coalesce((t_low OR t_up) AND NOT coalesce(lag(t_low OR t_up) OVER ({W}), false) AND max(t_mid::INT) {frame(1, 7)} = 1, false) AS c FROM bb)
SELECT {SHOWN}, a AS lower_touch, b AS upper_touch, c AS mid_reversion FROM f WHERE a OR b OR c""")
def band_filter_modes(spark, sf_dir):
    """Bars that one of the band filter's modes lets through."""
    out = _long_bands(order_bars(spark, sf_dir))
    for mode in ("lower_touch", "upper_touch", "mid_reversion"):
        out = E.band_filter(out, mode).withColumnRenamed("bb_filter", mode)
    return show(out.where("lower_touch OR upper_touch OR mid_reversion"), ["lower_touch", "upper_touch", "mid_reversion"], [])


def _frame(spark, sf_dir):
    return S.strategy_signals(I.strategy_frame(event_bars(spark, sf_dir), main=100), main="sma_100")


def _trades(signal: str, direction: str, rule: str = "fixed", tp: float = 0.02, sl: float = 0.01, bars: int = 48, lev: int = 10, fee: float = 0.0004) -> str:
    """SQL of trades: a range join of entries and bars, and the first bar that ends each."""
    s = 1 if direction == "long" else -1
    up, down = ("b.high >= {}", "b.low <= {}") if s > 0 else ("b.low <= {}", "b.high >= {}")
    own = {"connors": f"WHEN b.close {'>' if s > 0 else '<'} b.s1 THEN 'Exit' ", "squeeze": f"WHEN b.close {'<' if s > 0 else '>'} b.mid THEN 'Exit' "}.get(rule, "")
    case = f"CASE WHEN {down.format(f'e.ep * (1 - {s} / {lev}::DOUBLE)')} THEN 'Liquidation' {own}WHEN {down.format(f'e.ep * (1 - {s} * {sl}::DOUBLE)')} THEN 'SL' WHEN {up.format(f'e.ep * (1 + {s} * {tp}::DOUBLE)')} THEN 'TP' END"
    return f"""en AS (SELECT * FROM (SELECT symbol, rn, open_dt AS sdt, lead(open) OVER ({W}) AS ep, lead(open_dt) OVER ({W}) AS edt, lead(regime) OVER ({W}) AS rg, lead(open_dt, 2) OVER ({W}) AS n2, {signal} AS sg FROM sg) WHERE sg AND n2 IS NOT NULL),
pa AS (SELECT e.symbol, e.sdt, e.edt, e.ep, e.rg, b.rn - e.rn AS o, b.open_dt AS xdt, b.close AS xc, {case} AS oc FROM en e JOIN sg b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + {bars + 1}),
tx AS (SELECT symbol, sdt, edt, ep, rg, coalesce(arg_min(oc, o) FILTER (oc IS NOT NULL), 'TimeOut') AS oc, coalesce(arg_min(xdt, o) FILTER (oc IS NOT NULL), arg_max(xdt, o)) AS xdt, coalesce(arg_min(xc, o) FILTER (oc IS NOT NULL), arg_max(xc, o)) AS xc FROM pa GROUP BY ALL),
ty AS (SELECT *, CASE oc WHEN 'Liquidation' THEN ep * (1 - {s} / {lev}::DOUBLE) WHEN 'SL' THEN ep * (1 - {s} * {sl}::DOUBLE) WHEN 'TP' THEN ep * (1 + {s} * {tp}::DOUBLE) ELSE xc END AS xp FROM tx),
td AS (SELECT *, CASE WHEN oc = 'Liquidation' THEN -1.0 ELSE {s} * (xp - ep) / ep * {lev} - {2 * fee * lev!r}::DOUBLE END AS pnl FROM ty)"""


TRADES = "symbol, sdt::VARCHAR AS signal_dt, edt::VARCHAR AS entry_dt, xdt::VARCHAR AS exit_dt, oc AS outcome, rg AS regime, " + ", ".join((s6("ep", "entry_price"), s6("xp", "exit_price"), s6("pnl")))


def _show_trades(trades):
    return show(trades, ["outcome", "regime"], ["entry_price", "exit_price", "pnl"], ["signal_dt", "entry_dt", "exit_dt"])


@register(f"WITH {STATES}, {FRAME}, {_trades('engulfing_long', 'long')} SELECT {TRADES} FROM td")
def backtest_fixed(spark, sf_dir):
    return _show_trades(B.run(_frame(spark, sf_dir), "engulfing_long"))


@register(f"WITH {STATES}, {FRAME}, {_trades('engulfing_short', 'short', 'connors', bars=20)} SELECT {TRADES} FROM td")
def backtest_connors_short(spark, sf_dir):
    return _show_trades(B.run(_frame(spark, sf_dir), "engulfing_short", B.Rules(direction="short", exit_rule="connors", max_bars=20)))


@register(f"WITH {STATES}, {FRAME}, {_trades('bb_breakout_long', 'long', 'squeeze', tp=0.5, sl=0.4, lev=2)} SELECT {TRADES} FROM td")
def backtest_squeeze(spark, sf_dir):
    return _show_trades(B.run(_frame(spark, sf_dir), "bb_breakout_long", B.Rules(exit_rule="squeeze", take_profit=0.5, stop_loss=0.4, leverage=2)))


_RISKY = _trades("engulfing_long", "long", tp=0.4, sl=0.2, bars=10, lev=2)


def _risky(spark, sf_dir):
    return B.run(_frame(spark, sf_dir), "engulfing_long", B.Rules(take_profit=0.4, stop_loss=0.2, max_bars=10, leverage=2))


@register(f"""WITH {STATES}, {FRAME}, {_RISKY} SELECT symbol, rg AS regime, count(*) AS n_trades, count(*) FILTER (oc = 'Liquidation') AS liq_count, {s6('count(*) FILTER (pnl > 0) / count(*)::DOUBLE * 100', 'win_rate')}, {s6('sum(pnl) * 100', 'total_pnl')},
{s6('avg(pnl) * 100', 'avg_pnl')} FROM td GROUP BY symbol, rg""")
def trade_summary_by_regime(spark, sf_dir):
    return show(B.summary(_risky(spark, sf_dir), "symbol", "regime"), ["regime", "n_trades", "liq_count"], ["win_rate", "total_pnl", "avg_pnl"], [])


@register(f"""WITH {STATES}, {FRAME}, {_RISKY}, c AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY edt ROWS UNBOUNDED PRECEDING) AS cs, sum((pnl >= 0)::INT) OVER (PARTITION BY symbol ORDER BY edt ROWS UNBOUNDED PRECEDING) AS wn, product(1 + pnl) OVER (PARTITION BY symbol ORDER BY edt ROWS UNBOUNDED PRECEDING) AS cp FROM td),
k AS (SELECT *, max(cp) OVER (PARTITION BY symbol ORDER BY edt ROWS UNBOUNDED PRECEDING) AS tp, max(cs) OVER (PARTITION BY symbol ORDER BY edt ROWS UNBOUNDED PRECEDING) AS pk FROM c), l AS (SELECT symbol, wn, count(*) FILTER (pnl < 0) AS ls FROM k GROUP BY ALL)
SELECT k.symbol, any_value(x.ml)::BIGINT AS max_losses, {s6('max(pk - cs)', 'max_dd')}, {s6('CASE WHEN max(pk) > 0 THEN max(pk - cs) / (max(pk) + 1e-10) * 100 ELSE 0.0 END', 'max_dd_pct')}, {s6('min(CASE WHEN tp <> 0 THEN (cp - tp) / tp END)', 'max_dd_compounded')} FROM k JOIN (SELECT symbol, max(ls) AS ml FROM l GROUP BY symbol) x USING (symbol) GROUP BY k.symbol""")
def drawdowns(spark, sf_dir):
    return show(B.drawdowns(_risky(spark, sf_dir)), ["max_losses"], ["max_dd", "max_dd_pct", "max_dd_compounded"], [])


@register(f"""WITH {STATES}, {FRAME}, {_RISKY} SELECT symbol, count(*) AS n_trades, {s6('avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252)', 'sharpe')}, {s6('avg(pnl) / nullif(stddev_samp(pnl) FILTER (pnl < 0), 0) * sqrt(252)', 'sortino')},
{s6('coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0)', 'profit_factor')}, {s6('coalesce(avg(pnl) FILTER (pnl > 0), 0) * 100', 'avg_win')}, {s6('coalesce(avg(pnl) FILTER (pnl < 0), 0) * 100', 'avg_loss')},
{s6('avg(pnl) / nullif(stddev_samp(pnl) / sqrt(count(*)), 0)', 't_statistic')} FROM td GROUP BY symbol""")
def trade_risk(spark, sf_dir):
    return show(B.risk(_risky(spark, sf_dir)), ["n_trades"], ["sharpe", "sortino", "profit_factor", "avg_win", "avg_loss", "t_statistic"], [])


_T = "t AS (SELECT symbol, count(*) AS n_trades, avg(pnl) AS mean, stddev_samp(pnl) AS sd, avg(pnl) / nullif(stddev_samp(pnl) / sqrt(count(*)), 0) AS t_statistic FROM td GROUP BY symbol)"


@register(f"WITH {STATES}, {FRAME}, {_RISKY}, {_T} SELECT symbol, n_trades, {s6('t_statistic')}, {s6(sql_t_two_sided('t_statistic', '(n_trades - 1)'), 'p_value')} FROM t")
def trade_t_test(spark, sf_dir):
    risk = with_t_test(B.risk(_risky(spark, sf_dir)), "t_statistic", "n_trades")
    return show(risk, ["n_trades"], ["t_statistic", "p_value"], [])


@register(f"""WITH {STATES}, {FRAME}, {_RISKY}, {_T}, q AS (SELECT symbol, n_trades, mean, sd, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi, 0 AS i FROM t
  UNION ALL SELECT symbol, n_trades, mean, sd, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, i + 1 FROM (SELECT *, {sql_t_two_sided('mid', '(n_trades - 1)')} AS p FROM (SELECT *, (lo + hi) / 2 AS mid FROM q WHERE i < 60))),
h AS (SELECT symbol, n_trades, mean, CASE WHEN n_trades >= 2 AND sd > 0 THEN lo * sd / sqrt(n_trades) ELSE 0.0 END AS half FROM q WHERE i = 60)
SELECT symbol, n_trades, {s6('mean')}, {s6('mean - half', 'ci_lower')}, {s6('mean + half', 'ci_upper')}, {s6('2 * half', 'ci_width')} FROM h""")
def trade_mean_interval(spark, sf_dir):
    """The mean PnL of a series' trades with its 95 % interval by Student's t."""
    means = _risky(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("sd"))
    return show(with_mean_interval(means, "mean", "sd", "n_trades"), ["n_trades"], ["mean", "ci_lower", "ci_upper", "ci_width"], [])


_DRAWN = "md5(concat_ws('|', '7', run, edt, sdt))"
_RUNS = f"{STATES}, {FRAME}, {_RISKY}, mc AS (SELECT td.symbol, edt, sdt, pnl, run, {_DRAWN} AS h FROM td, range(1, 201) AS x(run))"


@register(f"""WITH {_RUNS}, c AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol, run ORDER BY h, edt, sdt ROWS UNBOUNDED PRECEDING) AS cs FROM mc),
f AS (SELECT symbol, run, pnl, max(cs) OVER (PARTITION BY symbol, run ORDER BY h, edt, sdt ROWS UNBOUNDED PRECEDING) - cs AS fall FROM c), e AS (SELECT symbol, run, sum(pnl) AS final, max(fall) AS fall, count(*) AS n FROM f GROUP BY symbol, run)
SELECT symbol, count(*) AS runs, {s6('avg(final) * 100', 'mean_final_pnl')}, {s6('quantile_cont(fall, 0.5) * 100', 'median_max_dd')}, {s6('quantile_cont(fall, 0.95) * 100', 'p95_max_dd')} FROM e WHERE n >= 5 GROUP BY symbol""")
def monte_carlo_drawdown(spark, sf_dir):
    return show(B.monte_carlo(_risky(spark, sf_dir), runs=200), ["runs"], ["mean_final_pnl", "median_max_dd", "p95_max_dd"], [])


@register(f"""WITH {_RUNS}, u AS (SELECT *, ('0x' || substr(h, 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM mc),
w AS (SELECT *, {" + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in B.POISSON)} AS w FROM u), e AS (SELECT symbol, run, sum(w * pnl) / nullif(sum(w), 0) * count(*) * 100 AS final, count(*) AS n FROM w GROUP BY symbol, run),
g AS (SELECT symbol, n, CASE WHEN n >= 18 THEN final END AS final FROM e)
SELECT symbol, max(n) AS n_trades, count(final) AS runs, {s6('avg(final)', 'mean_final_pnl')}, {s6('quantile_cont(final, 0.025)', 'ci_lower')}, {s6('quantile_cont(final, 0.975)', 'ci_upper')}, {s6('min(final)', 'worst_case')}, {s6('max(final)', 'best_case')} FROM g GROUP BY symbol""")
def pnl_bootstrap(spark, sf_dir):
    """Resamples of each series' trades; series of fewer than 18 of them have nulls."""
    out = B.bootstrap(_risky(spark, sf_dir), runs=200, min_trades=18)
    return show(out, ["n_trades", "runs"], ["mean_final_pnl", "ci_lower", "ci_upper", "worst_case", "best_case"], [])


_SPLIT = _RISKY.replace("FROM sg)", "FROM s2)").replace("JOIN sg b", "JOIN s2 b")


@register(f"""WITH {STATES}, {FRAME}, s2 AS (SELECT * EXCLUDE (symbol, n), symbol || '|' || CASE WHEN rn - 100 <= floor((n - 100) * 0.7) THEN 'train' ELSE 'test' END AS symbol FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM sg) WHERE rn > 100), {_SPLIT}
SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS split, count(*) AS n_trades, count(*) FILTER (oc = 'Liquidation') AS liq_count, {s6('count(*) FILTER (pnl > 0) / count(*)::DOUBLE * 100', 'win_rate')}, {s6('sum(pnl) * 100', 'total_pnl')},
{s6('avg(pnl) * 100', 'avg_pnl')}, {s6('(product(1 + pnl) - 1) * 100', 'compounded_pnl')} FROM td GROUP BY symbol""")
def backtest_train_test(spark, sf_dir):
    bars = B.splits(_frame(spark, sf_dir), warm_up=100)
    trades = B.run(bars, "engulfing_long", B.Rules(take_profit=0.4, stop_loss=0.2, max_bars=10, leverage=2), keep=("split",))
    return show(B.summary(trades, "symbol", "split"), ["split", "n_trades", "liq_count"], ["win_rate", "total_pnl", "avg_pnl", "compounded_pnl"], [])


@register(f"""WITH {EVENT_BARS}, n AS (SELECT symbol, max(rn) AS n FROM bars GROUP BY symbol), e AS (SELECT b.*, n.n FROM bars b JOIN n USING (symbol) WHERE rn <= n.n - 5 AND close > open),
p AS (SELECT e.symbol, e.open_dt AS edt, e.close AS ep, b.rn - e.rn AS o, b.close AS xc, CASE WHEN b.low <= e.close * (1 - 1.0::DOUBLE / 100) THEN 'SL' WHEN b.high >= e.close * (1 + 2.0::DOUBLE / 100) THEN 'TP' WHEN b.rn - e.rn = 5 THEN 'Time' END AS reason
  FROM e JOIN bars b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + 5),
x AS (SELECT symbol, edt, ep, arg_min(reason, o) FILTER (reason IS NOT NULL) AS reason, min(o) FILTER (reason IS NOT NULL) AS hold, arg_min(xc, o) FILTER (reason IS NOT NULL) AS xc FROM p GROUP BY ALL),
y AS (SELECT *, CASE reason WHEN 'SL' THEN ep * (1 - 1.0::DOUBLE / 100) WHEN 'TP' THEN ep * (1 + 2.0::DOUBLE / 100) ELSE xc END AS xp FROM x)
SELECT symbol, edt::VARCHAR AS entry_dt, reason, hold::BIGINT AS hold, xp > ep AS is_win, {s6('ep', 'entry_price')}, {s6('xp', 'exit_price')}, {s6('(xp - ep) / ep * 100', 'pnl')} FROM y""")
def backtest_at_close(spark, sf_dir):
    bars = event_bars(spark, sf_dir).withColumn("green", F.col("close") > F.col("open"))
    return show(B.run_at_close(bars, "green"), ["reason", "hold", "is_win"], ["entry_price", "exit_price", "pnl"], ["entry_dt"])


_CHAIN = f"""RECURSIVE {EVENT_BARS}, {CUTLER}, m AS (SELECT *, {rolled('avg', 'close', 20)} AS m20 FROM cu),
rd AS (SELECT *, (lag(close) OVER ({W}) / nullif(lag(open) OVER ({W}), 0) - 1) * 100 <= -10.0 AND lag(rsi_sma) OVER ({W}) < 60 AND close > open AND close > m20 AS ready FROM m),
en AS (SELECT symbol, rn, open_dt AS edt, open AS ep, open * (1 - 20.0::DOUBLE / 100) AS st, open * (1 + 40.0::DOUBLE / 100) AS tg FROM rd WHERE ready),
ex AS (SELECT en.*, (SELECT min(b.rn) FROM bars b WHERE b.symbol = en.symbol AND b.rn > en.rn AND (b.low <= st OR b.high >= tg)) AS xr FROM en),
ch AS (SELECT * FROM ex QUALIFY row_number() OVER ({W.replace('open_dt', 'rn')}) = 1
  UNION ALL SELECT ex.* FROM ch JOIN ex ON ex.symbol = ch.symbol AND ex.rn > ch.xr QUALIFY row_number() OVER (PARTITION BY ex.symbol ORDER BY ex.rn) = 1),
tr1 AS (SELECT ch.*, b.open_dt AS xdt, b.low <= st AS sl, b.high >= tg AS tp FROM ch JOIN bars b ON b.symbol = ch.symbol AND b.rn = ch.xr),
one AS (SELECT symbol, edt, xdt, ep, CASE WHEN sl THEN st ELSE tg END AS xp, CASE WHEN sl AND tp THEN 'SL and TP' WHEN sl THEN 'SL' ELSE 'TP' END AS reason FROM tr1)"""
_ONE = f"SELECT symbol, edt::VARCHAR AS entry_dt, xdt::VARCHAR AS exit_dt, reason, {s6('ep', 'entry_price')}, {s6('xp', 'exit_price')}, {s6('(xp - ep) / ep * 100', 'pnl')} FROM one"


def _one_at_a_time(spark, sf_dir, gated: bool):
    bars = event_bars(spark, sf_dir)
    sharpes = I.series_returns(resample(bars, "4 hours", "4h")) if gated else None
    bars = I.rsi_cutler(I.moving_averages(bars, (20,))).withColumn("uptrend", F.col("close") > F.col("sma_20"))
    trades = B.run_one_at_a_time(bars, take_profit=40.0, stop_loss=20.0, pullback=10.0, oversold=60.0, sharpes=sharpes, least_sharpe=3.0)
    return show(trades, ["reason"], ["entry_price", "exit_price", "pnl"], ["entry_dt", "exit_dt"])


@register(f"WITH {_CHAIN} {_ONE}")
def backtest_one_at_a_time(spark, sf_dir):
    return _one_at_a_time(spark, sf_dir, False)


@register(f"""WITH {_CHAIN}, {FOUR.partition('hs AS')[0].rstrip().rstrip(',')}, g4 AS (SELECT symbol, close / nullif(lag(close) OVER ({W}), 0) - 1 AS ret FROM h4),
sh AS (SELECT symbol FROM g4 GROUP BY symbol HAVING avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) > 3) {_ONE} WHERE symbol IN (SELECT symbol FROM sh)""")
def backtest_gated(spark, sf_dir):
    """One trade at a time, only where the four-hour Sharpe ratio is above 3."""
    return _one_at_a_time(spark, sf_dir, True)


@register(f"""WITH {EVENT_BARS}, p AS (SELECT *, close > open AND lag(close < open) OVER ({W}) AS ev, (lead(close, 5) OVER ({W}) / nullif(close, 0) - 1) * 100 AS r FROM bars)
SELECT symbol, count(*) AS events, count(r) AS complete, {s6('avg(r)', 'avg_ret')} FROM p WHERE ev GROUP BY symbol""")
def five_bar_return(spark, sf_dir):
    bars = P.sequence_match(event_bars(spark, sf_dir), [-1, 1])
    return show(E.after_return(bars, "matched"), ["events", "complete"], ["avg_ret"], [])
