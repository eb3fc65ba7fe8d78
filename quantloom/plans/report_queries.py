"""Queries of reports: the complex streak study, live and dashboard views, presets, equity, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import complex_study as X
from quantloom.operators import events as E
from quantloom.operators import indicators as I
from quantloom.operators import joins as J
from quantloom.operators import levels as L
from quantloom.operators import patterns as P
from quantloom.operators import rollup as R
from quantloom.operators import scan as C
from quantloom.operators import streak as K
from quantloom.plans.base import BB, EVENT_BARS, SHOWN, W, frame, register, rolled, s6, show
from quantloom.plans.event_queries import _RISKY, EVENT, _bands, _risky
from quantloom.plans.indicator_queries import _HYBRID, CUTLER, FRAME, SIG, STATES, SUPERTREND, TR
from quantloom.plans.streak_queries import ODDS, SEG, _cut, odds
from quantloom.sources.bars import event_bars

_LEADS = ", ".join(f"lead({c}, {k}) OVER ({W}) AS n{c}{k}" for c in ("open", "close", "open_dt") for k in (1, 2))
_FOLLOW = f"""{CUTLER}, s AS (SELECT *, {SEG}, {_LEADS}, close / nullif({rolled('avg', 'close', 20)}, 0) * 100 AS disp FROM cu), {TR},
ar AS (SELECT symbol, open_dt AS adt, CASE WHEN close <> 0 THEN {rolled('avg', 'tr', 14)} / close * 100 END AS atr_pct FROM tr),
m AS (SELECT s.*, atr_pct, greatest(high2, high1) AS hi, (volume1 + volume2) / 2 AS vr FROM s JOIN ar ON ar.symbol = s.symbol AND adt = open_dt WHERE close2 > open2 AND close1 > open1 AND close < open AND nopen_dt1 IS NOT NULL),
q AS (SELECT *, least(100.0, CASE WHEN hi > open2 THEN (hi - close) / (hi - open2) * 100 ELSE 0.0 END) AS retracement, CASE WHEN vr > 0 THEN volume / vr ELSE 1.0 END AS vol_ratio, coalesce(rsi_sma, 50) AS rsi FROM m),
z AS (SELECT *, CASE WHEN retracement < 30 THEN 40 WHEN retracement < 50 THEN 30 WHEN retracement < 70 THEN 15 ELSE 0 END + CASE WHEN vol_ratio < 0.7 THEN 30 WHEN vol_ratio < 1 THEN 20 WHEN vol_ratio < 1.5 THEN 10 ELSE 0 END
  + CASE WHEN rsi > 70 THEN 30 WHEN rsi > 65 THEN 25 WHEN rsi > 60 THEN 15 ELSE 0 END AS score, nclose1 > nopen1 AS g1, CASE WHEN nopen_dt2 IS NOT NULL THEN coalesce(nclose2 > nopen2, false) END AS g2 FROM q)"""


def _followed(spark, sf_dir):
    bars = P.sequence_match(I.disparity(I.atr_mean(I.rsi_cutler(event_bars(spark, sf_dir)))), [1, 1, -1])
    return X.follow_ups(bars, "matched", 2, 1)


@register(f"""WITH {EVENT_BARS}, {_FOLLOW} SELECT {SHOWN}, nopen_dt1::VARCHAR AS c1_dt, CASE WHEN g1 THEN 'green' ELSE 'red' END AS c1_color, CASE WHEN g2 THEN 'green' WHEN NOT g2 THEN 'red' END AS c2_color, g1 AS c1_success, g2 AS c2_success,
score::BIGINT AS score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS confidence, {s6('retracement')}, {s6('vol_ratio')}, {s6('rsi')},
{s6('(nclose1 - nopen1) / nullif(nopen1, 0) * 100', 'c1_ret')}, {s6('(nclose2 - nopen2) / nullif(nopen2, 0) * 100', 'c2_ret')} FROM z""")
def complex_follow_ups(spark, sf_dir):
    """Scored pullbacks with the two bars after them."""
    return show(_followed(spark, sf_dir), ["c1_color", "c2_color", "c1_success", "c2_success", "score", "confidence"], ["retracement", "vol_ratio", "rsi", "c1_ret", "c2_ret"], ["open_dt", "c1_dt"])


_STUDIES = {"rsi": ("rsi", K.RSI_BINS), "retracement": ("retracement", K.RETRACEMENT_BINS), "disparity": ("disp", K.DISPARITY_BINS), "atr_pct": ("atr_pct", K.ATR_BINS)}


@register(f"WITH {EVENT_BARS}, {_FOLLOW} " + " UNION ALL ".join(
    f"SELECT symbol, study, bin_no::BIGINT AS bin_no, n, k, {odds('k', 'n')} FROM (SELECT symbol, '{name}' AS study, {_cut(c, edges)} AS bin_no, count(*) AS n, count(*) FILTER (g1) AS k FROM z GROUP BY ALL) WHERE bin_no IS NOT NULL"
    for name, (c, edges) in _STUDIES.items()))
def complex_intervals(spark, sf_dir):
    """Odds of a green bar after a pullback, by intervals of four figures of the pullback."""
    rows = X.with_green(_followed(spark, sf_dir))
    out = None
    for name, (_, edges) in _STUDIES.items():
        one = K.binned_odds(rows, name, "c1_green", edges).withColumn("study", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return show(out, ["study", "bin_no", "n", "k", "reliability"], ODDS, [])


@register(f"""WITH {EVENT_BARS}, {_FOLLOW} SELECT symbol, count(*) AS total, count(*) FILTER (g1) AS success, count(*) FILTER (NOT g1) AS failure, {s6('count(*) FILTER (g1) / count(*)::DOUBLE * 100', 'success_rate')},
{", ".join(s6(f"avg({c}) FILTER ({g})", f"{s}_{c}") for s, g in (("success", "g1"), ("failure", "NOT g1")) for c in ("rsi", "vol_ratio"))} FROM z GROUP BY symbol""")
def complex_comparison(spark, sf_dir):
    """Pullbacks that the next bar confirmed against those that it did not."""
    rounded = ["success_rate", *[f"{s}_{c}" for s in ("success", "failure") for c in ("rsi", "vol_ratio")]]
    return show(X.comparative_report(_followed(spark, sf_dir)), ["total", "success", "failure"], rounded, [])


_PARTS = {"sma_adx_strong": {"sma_20 above sma_50": "s20 > s50", "adx above 25": "adx > 25"}, "macd_rsi_trend": {"macd_hist above 0": "macd - sig > 0", "rsi above 55": "rsi > 55", "close above sma_200": "close > s200"}, "pure_trend": {"close above sma_200": "close > s200"}}


@register(f"WITH {STATES}, {_HYBRID}, l AS (SELECT * FROM hy QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_dt DESC) = 2) " + " UNION ALL ".join(
    f"SELECT {SHOWN}, '{s}' AS strategy, {s} AS is_active, '{part}' AS part, {c} AS holds, {s6('close')} FROM l" for s, parts in _PARTS.items() for part, c in parts.items()))
def hybrid_live(spark, sf_dir):
    """The hybrid rules and their parts on the latest closed bar."""
    return show(C.hybrid_live(event_bars(spark, sf_dir)), ["strategy", "is_active", "part", "holds"], ["close"])


_STOCH = ((5, 3), (10, 6), (20, 12))


@register(f"""WITH {STATES}, rs AS (SELECT *, 100 * (rsi - {rolled('min', 'rsi', 14)}) / ({rolled('max', 'rsi', 14)} - {rolled('min', 'rsi', 14)} + 1e-10) AS f FROM sx),
x AS (SELECT *, {", ".join(f"CASE WHEN {rolled('max', 'high', n)} - {rolled('min', 'low', n)} <> 0 THEN 100 * (close - {rolled('min', 'low', n)}) / ({rolled('max', 'high', n)} - {rolled('min', 'low', n)}) END AS f{n}" for n, _ in _STOCH)},
  {", ".join(f"{rolled('avg', 'close', n)} AS s{n}" for n in (20, 50, 200))}, CASE WHEN rn >= 20 THEN sum((high + low + close) / 3 * volume) {frame(-19, 0)} / (sum(volume) {frame(-19, 0)} + 1e-10) END AS vw FROM rs),
y AS (SELECT *, {", ".join(f"{rolled('avg', f'f{n}', k)} AS k{n}" for n, k in _STOCH)} FROM x), z AS (SELECT *, {", ".join(f"{rolled('avg', f'k{n}', k)} AS d{n}" for n, k in _STOCH)} FROM y),
{SUPERTREND}, v AS (SELECT z.*, CASE WHEN s.onu THEN s.u ELSE s.l END AS line, row_number() OVER (PARTITION BY z.symbol ORDER BY z.open_dt DESC) AS back FROM z LEFT JOIN s USING (symbol, rn))
SELECT {SHOWN}, back = 1 AS is_latest, (CASE WHEN close > line THEN 1 ELSE -1 END)::BIGINT AS supertrend_dir, {s6('close')}, {s6('rsi', 'rsi_14')}, {s6('macd - sig', 'macd_hist')}, {s6('adx', 'adx_14')}, {s6('atr14', 'atr_14')}, {s6('CASE WHEN close <> 0 THEN atr14 / close * 100 END', 'atr_pct')},
{", ".join(s6(f"s{n}", f"sma_{n}") for n in (20, 50, 200))}, {", ".join(s6(f"{c}{n}", f"stoch_{n}_{k}_{k}_{c}") for n, k in _STOCH for c in "kd")}, {s6('vw', 'vwap')}, {s6('line', 'supertrend')} FROM v WHERE back <= 200""")
def trend_dashboard(spark, sf_dir):
    """The last 200 bars of each series with everything that the trend view shows."""
    shown = ["close", "rsi_14", "macd_hist", "adx_14", "atr_14", "atr_pct", "sma_20", "sma_50", "sma_200", *[f"stoch_{n}_{k}_{k}_{c}" for n, k in _STOCH for c in "kd"], "vwap", "supertrend"]
    return show(C.dashboard(event_bars(spark, sf_dir)), ["is_latest", "supertrend_dir"], shown)


@register(f"WITH {STATES}, {FRAME}, l AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_dt DESC) = 2) " + " UNION ALL ".join(
    f"SELECT symbol, '{d} {s} ' || symbol AS name, '{s}' AS strategy, '{d}' AS direction, coalesce({s}_{d}, false) AS \"on\" FROM l" for s in SIG for d in ("long", "short")))
def preset_scan(spark, sf_dir):
    """A preset for each series, strategy and direction, and whether it is on."""
    bars = event_bars(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(s.upper()).alias("strat_id"), F.lit(d.capitalize()).alias("direction"), F.lit(f"{d} {s} ").alias("label")) for s in SIG for d in ("long", "short")])
    presets = bars.select(F.col("symbol").alias("coin"), "interval").distinct().select("coin", "interval", F.inline(kinds)).withColumn("name", F.concat("label", "coin"))
    return C.preset_scan(bars, presets, main=100).select("symbol", "name", "strategy", "direction", "on")


@register(f"""WITH {STATES}, {FRAME}, {_RISKY} SELECT symbol, sdt::VARCHAR AS signal_dt, edt::VARCHAR AS entry_dt, {s6('100 * product(1 + pnl) OVER (PARTITION BY symbol ORDER BY edt, sdt ROWS UNBOUNDED PRECEDING)', 'equity')} FROM td""")
def equity_curve(spark, sf_dir):
    return show(L.equity(_risky(spark, sf_dir)), [], ["equity"], ["signal_dt", "entry_dt"])


@register(f"WITH {EVENT_BARS}, {BB}, {EVENT} SELECT {SHOWN}, {s6('close')} FROM bars WHERE (symbol, open_dt) IN (SELECT (symbol, open_dt) FROM ev WHERE ev)")
def bars_at_events(spark, sf_dir):
    """The bars whose times a list of events names."""
    events = E.first_touches(_bands(spark, sf_dir), "upper").where("event")
    return show(J.semi(event_bars(spark, sf_dir), events), [], ["close"])


_LEVELS = ((("symbol", "period"), "symbol, period"), (("symbol",), "symbol"), (("period",), "period"), ((), ""))


@register("WITH t AS (SELECT event_type AS symbol, date_trunc('week', ts)::DATE AS period, value, user_id FROM events WHERE value IS NOT NULL) " + " UNION ALL ".join(
    f"""SELECT {'symbol' if 'symbol' in keys else 'NULL::VARCHAR AS symbol'}, {'period::VARCHAR AS period' if 'period' in keys else 'NULL::VARCHAR AS period'}, '{','.join(keys)}' AS level, count(*) AS n, {s6('min(value)', 'least')}, {s6('max(value)', 'most')},
    {s6('sum(value)', 'total')}, true AS quartiles_hold, true AS distinct_holds FROM t {f'GROUP BY {group}' if group else ''}""" for keys, group in _LEVELS))
def rollup_sketches(spark, sf_dir):
    """Weeks and totals of each and of all series from day rows; the estimates are held against the exact figures."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "symbol")
    out = R.estimated(R.merged(R.day_rows(ticks, ["symbol"], "ts", "value", "user_id"), ["symbol"], "week"))
    known = ticks.where("value IS NOT NULL").withColumn("period", F.date_trunc("week", F.col("ts")).cast("date"))
    near = [F.percentile("value", min(1.0, max(0.0, q + d))).alias(f"q{round(q * 100)}_{i}") for q in (0.25, 0.5, 0.75) for i, d in enumerate((-0.05, 0.05))]
    sets = [[F.col(c) for c in keys] for keys, _ in _LEVELS]
    exact = known.groupingSets(sets, F.col("symbol"), F.col("period")).agg(F.count_distinct("user_id").alias("exact"), *near)
    both = out.join(exact.withColumnsRenamed({"symbol": "_s", "period": "_p"}), F.expr("symbol <=> _s AND period <=> _p"))
    hold = F.lit(True)
    for q in (25, 50, 75):
        hold = hold & F.col(f"p{q}").between(F.col(f"q{q}_0"), F.col(f"q{q}_1"))
    both = both.withColumns({"quartiles_hold": hold, "distinct_holds": F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")})
    return show(both.withColumn("period", F.col("period").cast("string")), ["period", "level", "n", "quartiles_hold", "distinct_holds"], ["least", "most", "total"], [])
