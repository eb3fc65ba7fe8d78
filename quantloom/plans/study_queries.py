"""Queries of conditions, scanners, projections and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import frames
from quantloom.operators import events as E
from quantloom.operators import indicators as I
from quantloom.operators import patterns as P
from quantloom.operators import scan as C
from quantloom.operators import signals as S
from quantloom.operators import signal_sweep, sweep
from quantloom.operators.streak import with_odds
from quantloom.plans.base import BB, EVENT_BARS, ORDER_BARS, SHOWN, W, frame, register, rolled, s6, show
from quantloom.plans.indicator_queries import CUTLER, FRAME, SIG, STATES
from quantloom.plans.streak_queries import ODDS, odds
from quantloom.sources.bars import event_bars, order_bars, part_bars


@register(f"""WITH {EVENT_BARS}, {CUTLER}, x AS (SELECT *, (coalesce(rsi_sma >= 55, false) OR coalesce(rsi_sma <= 35, false)) AND coalesce(sum((close > open)::INT) {frame(-1, 0)} = 2, false) AND NOT coalesce(volume > 8, false) AS c, lead(close > open) OVER ({W}) AS nx FROM cu),
g AS (SELECT symbol, count(*) AS n, count(*) FILTER (nx) AS k FROM x WHERE c AND nx IS NOT NULL GROUP BY symbol) SELECT symbol, n, k, {odds('k', 'n')} FROM g""")
def condition_probability(spark, sf_dir):
    """Odds of a green bar after (RSI high or low) and two green bars and no large volume."""
    bars = P.streak_match(I.directional(I.rsi_cutler(event_bars(spark, sf_dir))), 2, name="two_green")
    rsi = F.col("rsi_sma")
    condition = S.all_of(S.any_of(rsi >= 55, rsi <= 35), F.col("two_green"), S.none_of(F.col("volume") > 8))
    return show(with_odds(E.next_bar_probability(bars, condition, F.col("is_green"))), ["n", "k", "reliability"], ODDS, [])


@register(f"""WITH {EVENT_BARS}, {BB}, x AS (SELECT *, close > up AND lag(close) OVER ({W}) <= lag(up) OVER ({W}) AS c, lead(close < open) OVER ({W}) AS nx FROM bb),
g AS (SELECT symbol, count(*) AS n, count(*) FILTER (nx) AS k FROM x WHERE c AND nx IS NOT NULL GROUP BY symbol) SELECT symbol, n, k, {odds('k', 'n')} FROM g""")
def band_cross_probability(spark, sf_dir):
    bars = I.bollinger(event_bars(spark, sf_dir))
    return show(with_odds(E.next_bar_probability(bars, S.crosses_above("close", "bb_up"), F.col("close") < F.col("open"))), ["n", "k", "reliability"], ODDS, [])


@register(f"""WITH {EVENT_BARS}, x AS (SELECT *, {rolled('avg', 'close', 5)} AS k, {rolled('avg', 'close', 20)} AS d FROM bars), y AS (SELECT *, lag(k) OVER ({W}) AS pk, lag(d) OVER ({W}) AS pd FROM x)
SELECT {SHOWN}, CASE WHEN k > d THEN 'golden' WHEN k < d THEN 'dead' END AS line_state, CASE WHEN pk <= pd AND k > d THEN 'golden' WHEN pk >= pd AND k < d THEN 'dead' END AS line_cross FROM y""")
def line_states(spark, sf_dir):
    """Which of two lines is above, and where they cross."""
    return show(S.line_states(I.moving_averages(event_bars(spark, sf_dir), (5, 20)), "sma_5", "sma_20", "line"), ["line_state", "line_cross"], [])


@register(f"""WITH {EVENT_BARS}, r AS (SELECT symbol, (close / nullif(lag(close) OVER ({W}), 0) - 1) * 100 AS r FROM bars), m AS (SELECT symbol, avg(r) FILTER (r > 0) AS up, avg(r) FILTER (r < 0) AS down FROM r GROUP BY symbol)
SELECT symbol, {s6('1.5 * abs(down)', 'stop_pct')}, {s6('2 * up', 'target_pct')} FROM m""")
def stops_from_means(spark, sf_dir):
    from quantloom.functions.windows import prev
    from quantloom.operators.streak import stops_from_means as stops

    change = F.when(prev("close") != 0, (F.col("close") / prev("close") - 1) * 100)
    rows = event_bars(spark, sf_dir).withColumn("_r", change).groupBy("symbol").agg(F.avg(F.when(F.col("_r") > 0, F.col("_r"))).alias("up"), F.avg(F.when(F.col("_r") < 0, F.col("_r"))).alias("down"))
    return show(stops(rows, "up", "down"), [], ["stop_pct", "target_pct"], [])


@register(f"WITH {STATES}, {FRAME}, l AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_dt DESC) = 2) " + " UNION ALL ".join(
    f"SELECT {SHOWN}, '{s}' AS strategy, coalesce({s}_long, false) AS long, coalesce({s}_short, false) AS short FROM l" for s in SIG))
def strategy_scan(spark, sf_dir):
    return show(C.strategy_scan(event_bars(spark, sf_dir), main=100), ["strategy", "long", "short"], [])


@register(f"""WITH {STATES}, f AS (SELECT *, max(high) {frame(-3, 0)} AS hh, min(low) {frame(-3, 0)} AS ll, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT b.symbol, b.open_dt, b.rn, b.close, b.high, b.low, r.up, r.dn FROM r JOIN bars b USING (symbol, rn))),
l AS (SELECT *, 3.0 / 7 * dn * 13 - up * 13 AS g3, up * 13 / (3.0 / 7) - dn * 13 AS l3, 7.0 / 3 * dn * 13 - up * 13 AS g7, up * 13 / (7.0 / 3) - dn * 13 AS l7 FROM f WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_dt DESC) = 1)
SELECT symbol, {s6('close')}, {s6('CASE WHEN g3 >= 0 THEN close + g3 WHEN l3 >= 0 THEN close - l3 ELSE close END', 'rsi_30')}, {s6('CASE WHEN g7 >= 0 THEN close + g7 WHEN l7 >= 0 THEN close - l7 ELSE close END', 'rsi_70')},
{s6('ll + 0.2 * (hh - ll)', 'stoch_20')}, {s6('ll + 0.8 * (hh - ll)', 'stoch_80')}, {s6('hh', 'stoch_hh')}, {s6('ll', 'stoch_ll')} FROM l""")
def price_projections(spark, sf_dir):
    return show(C.projections(event_bars(spark, sf_dir)), [], ["close", "rsi_30", "rsi_70", "stoch_20", "stoch_80", "stoch_hh", "stoch_ll"], [])


BASE = {"take_profit": 4.0, "stop_loss": 2.0, "max_hold": 6}


_SETS = ", ".join(f"({i}, {c['take_profit']!r}::DOUBLE, {c['stop_loss']!r}::DOUBLE, {int(c['max_hold'])})" for i, c in enumerate(sweep.candidates(BASE)))


_SWEEP = f"""{EVENT_BARS}, ps(param_id, tp, sl, mh) AS (VALUES {_SETS}), n AS (SELECT symbol, count(*) AS n, floor(count(*) * 0.7) AS cut FROM bars GROUP BY symbol),
e1 AS (SELECT b.symbol, b.rn, b.close AS ep, n.n, n.cut FROM bars b JOIN n USING (symbol) WHERE close > open),
e AS (SELECT symbol, rn, ep, CASE WHEN rn <= cut THEN 'train' ELSE 'test' END AS split, CASE WHEN rn <= cut THEN cut ELSE n END AS last FROM e1 UNION ALL SELECT symbol, rn, ep, 'full', n FROM e1),
x AS (SELECT e.*, ps.*, b.rn - e.rn AS o, b.low, b.high, b.close, ep * (1 - sl / 100) AS st, ep * (1 + tp / 100) AS tg FROM e JOIN ps ON e.rn + mh <= e.last JOIN bars b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + mh),
y AS (SELECT symbol, param_id, split, rn, arg_min((CASE WHEN low <= st THEN st WHEN high >= tg THEN tg ELSE close END - ep) / ep * 100, o) AS pnl FROM x WHERE low <= st OR high >= tg OR o = mh GROUP BY symbol, param_id, split, rn),
sw AS (SELECT symbol, param_id, split, count(*) AS n_trades, count(*) FILTER (pnl > 0) / count(*)::DOUBLE * 100 AS win_rate, sum(pnl) AS total_pnl, avg(pnl) AS avg_pnl FROM y GROUP BY symbol, param_id, split)"""


@register(f"WITH {_SWEEP} SELECT symbol, param_id::BIGINT AS param_id, split, n_trades, {s6('win_rate')}, {s6('total_pnl')}, {s6('avg_pnl')} FROM sw")
def parameter_sweep(spark, sf_dir):
    bars = event_bars(spark, sf_dir).withColumn("green", F.col("close") > F.col("open"))
    out = sweep.evaluate(bars, "green", sweep.candidates(BASE))
    return show(out, ["param_id", "split", "n_trades"], ["win_rate", "total_pnl", "avg_pnl"], [])


@register(f"""WITH {_SWEEP}, sc AS (SELECT *, (total_pnl * 0.75 + avg_pnl * 0.45 + (win_rate - 50) * 0.3 - greatest(0, 10 - n_trades) * 0.8) * greatest(0.35, least(1.0, n_trades / 80.0)) AS score FROM sw),
p AS (SELECT symbol, param_id, {", ".join(f"max({c}) FILTER (split = '{k}') AS {k}_{c}" for k in ("train", "test", "full") for c in ("score", "win_rate", "total_pnl", "n_trades"))} FROM sc GROUP BY symbol, param_id),
f AS (SELECT *, {", ".join(f"CASE WHEN test_score IS NOT NULL THEN test_{c} ELSE full_{c} END AS f_{c}" for c in ("score", "win_rate", "total_pnl", "n_trades"))}, CASE WHEN test_score IS NOT NULL THEN 0.75 ELSE 0.45 END AS w FROM p),
g AS (SELECT symbol, param_id, f_score * w + coalesce(full_score, f_score) * (1 - w) + coalesce(train_score, f_score) * 0.05 - abs(coalesce(train_win_rate, 0) - f_win_rate) * 0.25
  - greatest(0, coalesce(train_total_pnl, 0) - f_total_pnl) * 0.15 - greatest(0, coalesce(train_n_trades, 0) - f_n_trades) * 0.03 - greatest(0, 5 - f_n_trades) * 1.2 AS final FROM f WHERE f_score IS NOT NULL)
SELECT symbol, arg_max(param_id, (final, -param_id))::BIGINT AS param_id, {s6('max(final)', 'score')} FROM g GROUP BY symbol""")
def sweep_best(spark, sf_dir):
    bars = event_bars(spark, sf_dir).withColumn("green", F.col("close") > F.col("open"))
    return show(sweep.best(sweep.evaluate(bars, "green", sweep.candidates(BASE))), ["param_id"], ["score"], [])


@register(f"""WITH bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_dt) AS rn FROM (SELECT l_partkey::VARCHAR AS symbol, date_trunc('week', l_shipdate) AS open_dt, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS open,
  arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS close FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2)),
x AS (SELECT *, lag(close) OVER ({W}) AS p FROM bars) SELECT {SHOWN}, {s6('(close / nullif(p, 0) - 1) * 100', 'change')} FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_dt DESC) = 1""")
def latest_change_many_series(spark, sf_dir):
    """Latest bar of many short series with its change from the one before."""
    from quantloom.functions.windows import prev

    bars = part_bars(spark, sf_dir)
    return show(C.latest(bars.withColumn("change", F.when(prev("close") != 0, (F.col("close") / prev("close") - 1) * 100))), [], ["change"])


SWEPT = [
    {"strategy": "ma_cross", "fast_len": 10, "slow_len": 30}, {"strategy": "ma_cross", "fast_len": 7, "slow_len": 60, "max_hold": 40, "take_profit": 20.0, "stop_loss": 30.0},
    {"strategy": "band_breakout", "volume_factor": 0.9}, {"strategy": "band_breakout", "band_len": 15, "band_width": 1.2, "volume_factor": 0.8, "max_hold": 12},
    {"strategy": "mean_reversion", "slow_len": 30, "band_width": 0.1, "rsi_level": 45}, {"strategy": "squeeze", "band_width": 1.0, "atr_len": 14},
    {"strategy": "squeeze", "band_len": 25, "band_width": 1.2, "keltner_width": 1.0, "stop_loss": 4.0}, {"strategy": "trend", "adx_level": 12}, {"strategy": "trend", "fast_len": 50, "adx_level": 15},
    {"strategy": "turtle", "slow_len": 50}, {"strategy": "turtle", "channel_len": 33, "slow_len": 100, "max_hold": 60, "take_profit": 60.0, "stop_loss": 50.0},
]


def _swept_sql() -> tuple[str, str]:
    """The columns that the sets read, as frames of each length, and the condition of each set."""
    sets = [signal_sweep.USUAL | s for s in SWEPT]
    n_of = lambda *names: sorted({s[n] for s in sets for n in names})
    columns = [f"{rolled('avg', 'close', n)} AS m{n}" for n in n_of("fast_len", "slow_len", "band_len")] + [f"{rolled('stddev_samp', 'close', n)} AS d{n}" for n in n_of("band_len")]
    columns += [f"{rolled('avg', 'volume', n)} AS v{n}" for n in n_of("volume_len")] + [f"CASE WHEN rn > {n} THEN max(high) {frame(-n, -1)} END AS t{n}" for n in n_of("channel_len")]

    def condition(s) -> str:
        m, d, k = f"m{s['band_len']}", f"d{s['band_len']}", s["band_width"]
        lag = lambda c: f"lag({c}) OVER ({W})"
        on = f"coalesce({m} + {k} * {d} < {m} + {s['keltner_width']} * atr{s['atr_len']} AND {m} - {k} * {d} > {m} - {s['keltner_width']} * atr{s['atr_len']}, false)"
        return {
            "ma_cross": f"m{s['fast_len']} > m{s['slow_len']} AND {lag(f'm{s["fast_len"]}')} <= {lag(f'm{s["slow_len"]}')}",
            "band_breakout": f"close > {m} + {k} * {d} AND {lag('close')} <= {lag(f'{m} + {k} * {d}')} AND volume > {s['volume_factor']} * v{s['volume_len']}",
            "mean_reversion": f"close > m{s['slow_len']} AND close < {m} - {k} * {d} AND rsi < {100 - s['rsi_level']}",
            "squeeze": f"{lag(on)} AND NOT {on} AND close > {m}",
            "trend": f"adx >= {s['adx_level']} AND close > m{s['fast_len']} AND macd > sig",
            "turtle": f"close > t{s['channel_len']} AND close > m{s['slow_len']}",
        }[s["strategy"]]

    conditions = ", ".join(f"coalesce({condition(s)}, false) AS on{i}" for i, s in enumerate(sets))
    events = " UNION ALL ".join(
        f"SELECT symbol, rn, close AS ep, {i} AS param_id, {s['take_profit']!r}::DOUBLE AS tp, {s['stop_loss']!r}::DOUBLE AS sl, {s['max_hold']} AS mh FROM cn WHERE on{i}" for i, s in enumerate(sets)
    )
    return f"fr AS (SELECT *, {', '.join(columns)} FROM sx), cn AS (SELECT *, {conditions} FROM fr)", events


_FRAMES, _EVENTS = _swept_sql()


@register(f"""WITH {STATES}, {_FRAMES}, n AS (SELECT symbol, count(*) AS n, floor(count(*) * 0.7) AS cut FROM bars GROUP BY symbol), e1 AS ({_EVENTS}),
e AS (SELECT e1.*, CASE WHEN rn > cut THEN 'test' WHEN rn + mh <= cut THEN 'train' END AS split FROM e1 JOIN n USING (symbol) WHERE rn + mh <= n),
x AS (SELECT e.*, b.rn - e.rn AS o, b.low, b.high, b.close, ep * (1 - sl / 100) AS st, ep * (1 + tp / 100) AS tg FROM e JOIN bars b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + mh),
y AS (SELECT symbol, param_id, split, rn, arg_min((CASE WHEN low <= st THEN st WHEN high >= tg THEN tg ELSE close END - ep) / ep * 100, o) AS pnl FROM x WHERE low <= st OR high >= tg OR o = mh GROUP BY symbol, param_id, split, rn),
z AS (SELECT symbol, param_id, split, pnl FROM y WHERE split IS NOT NULL UNION ALL SELECT symbol, param_id, 'full', pnl FROM y)
SELECT symbol, param_id::BIGINT AS param_id, split, count(*) AS n_trades, {s6('count(*) FILTER (pnl > 0) / count(*)::DOUBLE * 100', 'win_rate')}, {s6('sum(pnl)', 'total_pnl')}, {s6('avg(pnl)', 'avg_pnl')} FROM z GROUP BY symbol, param_id, split""")
def strategy_sweep(spark, sf_dir):
    """Eleven sets of six strategies, with lengths and levels of their own, in one job."""
    return show(signal_sweep.evaluate(event_bars(spark, sf_dir), SWEPT), ["param_id", "split", "n_trades"], ["win_rate", "total_pnl", "avg_pnl"], [])


_FAR = (20, 500)


@register(f"""WITH {ORDER_BARS} SELECT {SHOWN}, {", ".join(s6(rolled(f, c, n), f"{k}_{n}") for n in _FAR for k, f, c in (("top", "max", "high"), ("bottom", "min", "low"), ("mean", "avg", "close"), ("dev", "stddev_samp", "close")))},
{", ".join(s6(f"max(high) {frame(1, n)}", f"ahead_{n}") for n in _FAR)} FROM bars""")
def long_frames(spark, sf_dir):
    """Channels, means and deviations of 20 and of 500 bars, and highs ahead, at the same price for a row."""
    out = order_bars(spark, sf_dir)
    for n in _FAR:
        out = frames.last_bars(out, n, {f"top_{n}": ("max", "high"), f"bottom_{n}": ("min", "low"), f"mean_{n}": ("avg", "close"), f"dev_{n}": ("stddev", "close")})
        out = frames.next_bars(out, n, {f"ahead_{n}": ("max", "high")})
    return show(out, [], [f"{k}_{n}" for n in _FAR for k in ("top", "bottom", "mean", "dev", "ahead")])
