"""Queries of streaks, bins, heat maps and distributions over days."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.stats import edge_score, p_label
from quantloom.operators import indicators as I
from quantloom.operators import patterns as P
from quantloom.operators import streak as K
from quantloom.plans.base import EVENT_BARS, SHOWN, W, frame, register, rolled, s6, show
from quantloom.plans.indicator_queries import CUTLER, TR
from quantloom.sources.bars import event_bars

Z = "1.959963984540054::DOUBLE"


def odds(k: str, n: str) -> str:
    """Rate, Wilson bounds and exact p of k of n."""
    centre, half = f"(({k})::DOUBLE / {n} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n})", f"{Z} * sqrt(({k})::DOUBLE / {n} * (1 - ({k})::DOUBLE / {n}) / {n} + {Z} * {Z} / (4.0 * {n} * {n})) / (1 + {Z} * {Z} / {n})"
    p = f"least(1.0, 2 * list_sum(list_transform(range(0, least({k}, {n} - {k}) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0::DOUBLE)))))"
    when = lambda v: f"CASE WHEN {n} > 0 THEN {v} END"
    return ", ".join((
        s6(when(f"({k})::DOUBLE / {n} * 100"), "rate"), s6(when(f"greatest(0.0, ({centre} - {half}) * 100)"), "ci_lower"), s6(when(f"least(100.0, ({centre} + {half}) * 100)"), "ci_upper"),
        s6(f"CASE WHEN {n} = 0 THEN 1.0 ELSE greatest(1e-16, {p}) END", "p_value"), f"CASE WHEN {n} >= 30 THEN 'high' WHEN {n} >= 10 THEN 'medium' ELSE 'low' END AS reliability",
    ))


ODDS = ["rate", "ci_lower", "ci_upper", "p_value"]


def _streaks(spark, sf_dir, n=3, direction="green", **kw):
    return P.streak_match(I.directional(event_bars(spark, sf_dir), direction), n, **kw)


GREEN = f"""gr AS (SELECT *, close > open AS g, CASE WHEN open <> 0 THEN (close - open) / open * 100 END AS body_pct FROM bars),
mt AS (SELECT *, coalesce(sum(g::INT) {frame(-2, 0)} = 3, false) AS m, lead(g) OVER ({W}) AS c1, lead(g, 2) OVER ({W}) AS c2, (lead(close) OVER ({W}) / nullif(close, 0) - 1) * 100 AS ret FROM gr)"""


@register(f"""WITH {EVENT_BARS}, {GREEN}, c AS (SELECT symbol, count(*) FILTER (m) AS cases, count(*) FILTER (m AND c1 IS NOT NULL) AS n, count(*) FILTER (m AND c1) AS k, count(*) FILTER (m AND c1 AND c2 IS NOT NULL) AS n_c2_after_green,
  count(*) FILTER (m AND c1 AND c2) AS k_c2_after_green, count(*) FILTER (m AND NOT c1 AND c2 IS NOT NULL) AS n_c2_after_red, count(*) FILTER (m AND NOT c1 AND c2) AS k_c2_after_red, avg(ret) FILTER (m) AS c1_ret FROM mt GROUP BY symbol)
SELECT symbol, cases, n, k, n_c2_after_green, k_c2_after_green, n_c2_after_red, k_c2_after_red, {s6('c1_ret')}, {odds('k', 'n')} FROM c""")
def streak_c1(spark, sf_dir):
    """Three green bars, then the next bars: counts, Wilson bounds and exact p per series."""
    counts = ["cases", "n", "k", "n_c2_after_green", "k_c2_after_green", "n_c2_after_red", "k_c2_after_red"]
    return show(K.streak_odds(_streaks(spark, sf_dir)), [*counts, "reliability"], ["c1_ret", *ODDS], [])


@register(f"""WITH {EVENT_BARS}, {GREEN} SELECT {SHOWN}, c1 AS c1_green, {s6('body_pct')}, {s6('ret', 'c1_ret')} FROM (SELECT *, sum(body_pct) {frame(-2, 0)} AS bs FROM mt) WHERE m AND bs >= 20""")
def streak_min_body(spark, sf_dir):
    return show(K.next_bars(_streaks(spark, sf_dir, min_body=20.0)).where("matched"), ["c1_green"], ["body_pct", "c1_ret"])


def _cut(value: str, edges, lowest: bool = False) -> str:
    return "CASE " + " ".join(f"WHEN {value} {'>=' if lowest and i == 0 else '>'} {a} AND {value} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + " END"


RSI_NEXT = f"rn2 AS (SELECT *, coalesce(lead(close > open) OVER ({W}), false) AS t FROM cu)"


@register(f"""WITH {EVENT_BARS}, {CUTLER}, {RSI_NEXT}, c AS (SELECT symbol, {_cut('rsi_sma', K.RSI_BINS)} AS bin_no, count(*) AS n, count(*) FILTER (t) AS k FROM rn2 GROUP BY 1, 2)
SELECT symbol, bin_no::BIGINT AS bin_no, n, k, {odds('k', 'n')} FROM c WHERE bin_no IS NOT NULL""")
def rsi_bins(spark, sf_dir):
    rows = K.next_bars(I.rsi_cutler(event_bars(spark, sf_dir)))
    return show(K.binned_odds(rows, "rsi_sma", "c1_green", K.RSI_BINS), ["bin_no", "n", "k", "reliability"], ODDS, [])


ATR_EDGES = (0.0, 25.0, 50.0, 75.0, 100.0, 1000.0)


@register(f"""WITH {EVENT_BARS}, {CUTLER}, {TR}, j AS (SELECT c.symbol, c.rsi_sma, t.atr / nullif(c.close, 0) * 100 AS ap, coalesce(lead(c.close > c.open) OVER (PARTITION BY c.symbol ORDER BY c.open_dt), false) AS t
  FROM cu c JOIN (SELECT symbol, open_dt, {rolled('avg', 'tr', 14)} AS atr FROM tr) t ON t.symbol = c.symbol AND t.open_dt = c.open_dt),
f AS (SELECT symbol, {_cut('rsi_sma', K.RSI_BINS, True)} AS x, {_cut('ap', ATR_EDGES, True)} AS y, count(*) AS n, count(*) FILTER (t) AS k FROM j GROUP BY 1, 2, 3),
g AS (SELECT s.symbol, x.x, y.y FROM (SELECT DISTINCT symbol FROM bars) s, range({len(K.RSI_BINS) - 1}) x(x), range({len(ATR_EDGES) - 1}) y(y)), c AS (SELECT g.symbol, g.x, g.y, coalesce(f.n, 0) AS n, coalesce(f.k, 0) AS k FROM g LEFT JOIN f ON f.symbol = g.symbol AND f.x = g.x AND f.y = g.y)
SELECT symbol, x::BIGINT AS x_bin, y::BIGINT AS y_bin, n, k, {odds('k', 'n')} FROM c""")
def heat_map_rsi_atr(spark, sf_dir):
    rows = K.next_bars(I.atr_mean(I.rsi_cutler(event_bars(spark, sf_dir))))
    return show(K.heat_map(rows, "rsi_sma", "atr_pct", "c1_green", K.RSI_BINS, ATR_EDGES), ["x_bin", "y_bin", "n", "k", "reliability"], ODDS, [])


DISP = "CASE " + " ".join(f"WHEN d >= {a} AND d {'<=' if i == len(K.DISPARITY_BINS) - 2 else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(K.DISPARITY_BINS, K.DISPARITY_BINS[1:], strict=False))) + " END"


@register(f"""WITH {EVENT_BARS}, x AS (SELECT symbol, {DISP} AS bin_no, d FROM (SELECT symbol, close / nullif({rolled('avg', 'close', 20)}, 0) * 100 AS d FROM bars))
SELECT symbol, bin_no::BIGINT AS bin_no, count(*) AS n, {s6('avg(d)', 'mean')}, {s6('median(d)', 'median')}, {s6('stddev_samp(d)', 'std')}, {s6('min(d)', 'min')}, {s6('max(d)', 'max')} FROM x WHERE bin_no IS NOT NULL GROUP BY symbol, bin_no""")
def disparity_bins(spark, sf_dir):
    return show(K.bin_stats(I.disparity(event_bars(spark, sf_dir)), "disparity", K.DISPARITY_BINS), ["bin_no", "n"], ["mean", "median", "std", "min", "max"], [])


@register(f"""WITH {EVENT_BARS}, {GREEN}, q AS (SELECT symbol, body_pct AS v, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY body_pct) AS i FROM mt WHERE m AND body_pct IS NOT NULL)
SELECT symbol, max(n) AS n, max(n) >= 3 AS trimmed, {s6('avg(v)', 'mean')}, {s6('stddev_samp(v)', 'std')}, {s6('min(v)', 'min')}, {s6('max(v)', 'max')} FROM q WHERE n < 3 OR (i > 1 AND i < n) GROUP BY symbol""")
def trimmed_bodies(spark, sf_dir):
    rows = _streaks(spark, sf_dir).where("matched")
    return show(K.trimmed(rows, "body_pct", "symbol", "interval"), ["n", "trimmed"], ["mean", "std", "min", "max"], [])


def _trim(value: str, rows: str) -> str:
    """Trimmed mean and deviation of ``value`` per series: without one smallest and one largest of three or more."""
    return f"""(SELECT symbol, max(n) AS n, max(n) >= 3 AS trimmed, avg(v) AS mean, stddev_samp(v) AS std, max(v) AS top FROM (SELECT symbol, v, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY v) AS i, row_number() OVER (PARTITION BY symbol ORDER BY v DESC) AS j
  FROM (SELECT symbol, {value} AS v FROM {rows}) WHERE v IS NOT NULL) WHERE n < 3 OR (i > 1 AND j > 1) GROUP BY symbol)"""


DIP, RISE = "(open - low) / nullif(open, 0) * 100", "(high - open) / nullif(open, 0) * 100"


def _study(spark, sf_dir):
    return I.disparity(I.rsi_cutler(I.directional(event_bars(spark, sf_dir))))


STUDY = f"""sd AS (SELECT symbol, open_dt, rn, open, high, low, close, volume, close > open AS g, CASE WHEN open <> 0 THEN (close - open) / open * 100 END AS body_pct, rsi_sma, (volume / nullif(lag(volume) OVER ({W}), 0) - 1) * 100 AS vol_change FROM cu)"""


@register(f"""WITH {EVENT_BARS}, {CUTLER}, {STUDY}, x AS (SELECT *, lag(g) OVER ({W}) AS l, sum(g::INT) {frame(-3, -2)} AS rg, count(*) {frame(-3, -2)} AS hv, lag(rsi_sma) OVER ({W}) AS p_rsi_sma, lag(body_pct) OVER ({W}) AS p_body_pct, lag(vol_change) OVER ({W}) AS p_vol_change FROM sd)
SELECT symbol, count(*) AS total, count(*) FILTER (g) AS success, {s6('count(*) FILTER (g) / count(*)::DOUBLE * 100', 'success_rate')}, {", ".join(s6(f"avg(p_{c}) FILTER ({'g' if s == 'success' else 'NOT g'})", f"{s}_{c}") for s in ("success", "failure") for c in ("rsi_sma", "body_pct", "vol_change"))}
FROM x WHERE hv = 2 AND rg = 2 AND NOT l GROUP BY symbol""")
def reversal_report(spark, sf_dir):
    return show(K.reversal_report(_study(spark, sf_dir), n=2), ["total", "success"], ["success_rate", *[f"{s}_{c}" for s in ("success", "failure") for c in ("rsi_sma", "body_pct", "vol_change")]], [])


@register(f"""WITH {EVENT_BARS}, {CUTLER}, {STUDY}, h AS (SELECT * FROM (SELECT *, sum(g::INT) {frame(-2, -1)} AS rg, lag(rsi_sma) OVER ({W}) AS pr, (high / nullif(open, 0) - 1) * 100 AS rise FROM sd) WHERE rg = 2 AND pr >= 55),
m AS (SELECT symbol, greatest(0.1, 0.6 * avg(rise)) AS rise FROM h GROUP BY symbol HAVING count(*) >= 3), r AS (SELECT h.*, m.rise AS er, h.open * (1 + m.rise / 100) AS en FROM h JOIN m USING (symbol))
SELECT symbol, count(*) AS signals, count(*) FILTER (high >= en) AS filled, count(*) FILTER (high >= en AND close < en) AS won, {s6('max(er)', 'entry_rise')}, {s6('coalesce(avg((en - close) / en * 100) FILTER (high >= en AND close < en), 0)', 'avg_profit')} FROM r GROUP BY symbol""")
def short_fill(spark, sf_dir):
    return show(K.short_fill(_study(spark, sf_dir), n=2, overbought=55), ["signals", "filled", "won"], ["entry_rise", "avg_profit"], [])


@register(f"""WITH {EVENT_BARS}, {GREEN}, {TR}, t14 AS (SELECT symbol, open_dt, {rolled('avg', 'tr', 14)} AS atr FROM tr), w AS (SELECT mt.*, t14.atr / nullif(close, 0) * 100 AS ap, lag(m) OVER (PARTITION BY mt.symbol ORDER BY mt.open_dt) AS am FROM mt JOIN t14 USING (symbol, open_dt)), a AS (SELECT * FROM w WHERE am),
d AS {_trim(DIP, 'a')}, r AS {_trim(RISE, 'a')}, g AS (SELECT symbol, count(*) AS n, avg(ap) AS ap, max({DIP}) AS worst FROM a GROUP BY symbol)
SELECT g.symbol, g.n, d.trimmed, {s6('d.mean', 'avg_dip')}, {s6('d.std', 'std_dip')}, {s6('d.top', 'practical_dip')}, {s6('r.mean', 'avg_rise')}, {s6('g.ap', 'avg_atr_pct')}, {s6('g.worst', 'extreme_dip')} FROM g JOIN d USING (symbol) JOIN r USING (symbol)""")
def volatility_after_streak(spark, sf_dir):
    """The bars after three green ones: usual and worst dips, rises and range."""
    rows = I.atr_mean(_streaks(spark, sf_dir))
    return show(K.volatility(rows, "matched"), ["n", "trimmed"], ["avg_dip", "std_dip", "practical_dip", "avg_rise", "avg_atr_pct", "extreme_dip"], [])


@register(f"""WITH {EVENT_BARS}, {CUTLER}, {STUDY}, f AS (SELECT *, sum(g::INT) {frame(-1, 0)} = 2 AS mm, sum(g::INT) {frame(-2, -1)} AS rg, lag(rsi_sma) OVER ({W}) AS pr FROM sd), mb AS (SELECT * FROM f WHERE mm), u AS {_trim(RISE, 'mb')},
h AS (SELECT f.*, greatest(0.1, 0.6 * coalesce(u.mean, 0.5)) AS er FROM f LEFT JOIN u USING (symbol) WHERE rg = 2 AND pr >= 55), e AS (SELECT *, open * (1 + er / 100) AS en FROM h),
q AS (SELECT symbol, count(*) AS signals, count(*) FILTER (high >= en) AS filled, count(*) FILTER (high >= en AND close < en) AS won, max(er) AS er, coalesce(avg((en - close) / en * 100) FILTER (high >= en AND close < en), 0) AS ap FROM e GROUP BY symbol HAVING count(*) >= 3 AND count(*) FILTER (high >= en) > 0),
z AS (SELECT *, filled / signals::DOUBLE * 100 AS fr, won / filled::DOUBLE * 100 AS wr, won / signals::DOUBLE * 100 AS ow FROM q)
SELECT symbol, signals, filled, won, CASE WHEN fr >= 70 THEN 'high' WHEN fr >= 50 THEN 'medium' ELSE 'low' END AS reliability, fr < 50 AS bias_warning, wr >= 60 AND fr >= 50 AS enabled, {s6('er', 'entry_rise')}, {s6('ap', 'avg_profit')}, {s6('fr', 'fill_rate')}, {s6('wr', 'win_rate')}, {s6('ow', 'overall_win_rate')} FROM z""")
def short_signal(spark, sf_dir):
    return show(K.short_signal(_study(spark, sf_dir), n=2, overbought=55), ["signals", "filled", "won", "reliability", "bias_warning", "enabled"], ["entry_rise", "avg_profit", "fill_rate", "win_rate", "overall_win_rate"], [])


@register(f"""WITH {EVENT_BARS}, {GREEN}, c AS (SELECT symbol, count(*) FILTER (m AND c1 IS NOT NULL) AS n, count(*) FILTER (m AND c1) AS k FROM mt GROUP BY symbol), o AS (SELECT symbol, n, {odds('k', 'n')} FROM c)
SELECT symbol, CASE WHEN p_value IS NULL THEN 'N/A' WHEN p_value < 0.01 THEN 'Very High' WHEN p_value < 0.05 THEN 'High' WHEN p_value < 0.1 THEN 'Medium' ELSE 'Low' END AS p_label,
{s6("CASE WHEN n = 0 OR rate IS NULL THEN 0 ELSE round(least(100, abs(rate - 50) * 2) * 0.45 + greatest(0, 1 - p_value) * 100 * 0.25 + least(100, n / 120.0::DOUBLE * 100) * 0.2 + CASE reliability WHEN 'high' THEN 90 WHEN 'medium' THEN 65 ELSE 35 END * 0.1, 2) END", 'edge_score')} FROM o""")
def edge_scores(spark, sf_dir):
    """How much an edge is worth, and how far its p-value can be relied on."""
    rows = K.streak_odds(_streaks(spark, sf_dir))
    rows = rows.withColumns({c: F.round(c, 6) for c in ("rate", "p_value")})
    return show(rows.withColumns({"p_label": p_label(F.col("p_value")), "edge_score": edge_score(F.col("rate"), F.col("p_value"), F.col("n"))}), ["p_label"], ["edge_score"], [])


SEG = ", ".join(f"lag({c}, {k}) OVER ({W}) AS {c}{k}" for c in ("open", "high", "low", "close", "volume") for k in (1, 2))


@register(f"""WITH {EVENT_BARS}, {CUTLER}, s AS (SELECT *, {SEG} FROM cu), m AS (SELECT *, greatest(high2, high1) AS hi, (volume1 + volume2) / 2 AS vr FROM s WHERE close2 > open2 AND close1 > open1 AND close < open),
q AS (SELECT *, least(100.0, CASE WHEN hi > open2 THEN (hi - close) / (hi - open2) * 100 ELSE 0.0 END) AS retracement, CASE WHEN vr > 0 THEN volume / vr ELSE 1.0 END AS vol_ratio, coalesce(rsi_sma, 50) AS rs FROM m),
z AS (SELECT *, CASE WHEN retracement < 30 THEN 40 WHEN retracement < 50 THEN 30 WHEN retracement < 70 THEN 15 ELSE 0 END + CASE WHEN vol_ratio < 0.7 THEN 30 WHEN vol_ratio < 1 THEN 20 WHEN vol_ratio < 1.5 THEN 10 ELSE 0 END
  + CASE WHEN rs > 70 THEN 30 WHEN rs > 65 THEN 25 WHEN rs > 60 THEN 15 ELSE 0 END AS score FROM q)
SELECT {SHOWN}, score::BIGINT AS score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS confidence, {s6('retracement')}, {s6('vol_ratio')} FROM z""")
def pullback_score(spark, sf_dir):
    bars = P.sequence_match(I.rsi_cutler(event_bars(spark, sf_dir)), [1, 1, -1])
    return show(K.signal_score(K.pullback_quality(bars, "matched", 2, 1)), ["score", "confidence"], ["retracement", "vol_ratio"])


NY = "hour(timezone('America/New_York', timezone('UTC', {}))) // 4"


@register(f"""WITH {EVENT_BARS}, d AS (SELECT symbol, open_dt::DATE AS day, arg_min(open_dt, (low, open_dt)) AS l, arg_min(open_dt, (-high, open_dt)) AS h, avg(CASE WHEN open > 0 THEN (high - low) / open * 100 END) AS rg FROM bars GROUP BY ALL),
p AS (SELECT *, {NY.format('l')} AS lp, {NY.format('h')} AS hp FROM d), t AS (SELECT symbol, count(*) FILTER (lp <> hp) AS n_days, count(*) AS all_days, avg(rg) AS range_pct FROM p GROUP BY symbol)
SELECT t.symbol, part::BIGINT AS part, n_days, all_days, (SELECT count(*) FROM p WHERE p.symbol = t.symbol AND lp <> hp AND lp = part) AS lows, (SELECT count(*) FROM p WHERE p.symbol = t.symbol AND lp <> hp AND hp = part) AS highs, {s6('range_pct')} FROM t, range(6) r(part)""")
def intraday_extremes_ny(spark, sf_dir):
    return show(K.intraday_extremes(event_bars(spark, sf_dir)), ["part", "n_days", "all_days", "lows", "highs"], ["range_pct"], [])


@register(f"""WITH {EVENT_BARS}, w AS (SELECT symbol, date_trunc('week', open_dt) AS wk, arg_min(open_dt, (low, open_dt)) AS l, arg_min(open_dt, (-high, open_dt)) AS h FROM bars GROUP BY ALL HAVING count(*) >= 3),
u AS (SELECT symbol, isodow(l) - 1 AS weekday, 1 AS lo, 0 AS hi FROM w UNION ALL SELECT symbol, isodow(h) - 1, 0, 1 FROM w) SELECT symbol, weekday::BIGINT AS weekday, sum(lo)::BIGINT AS lows, sum(hi)::BIGINT AS highs FROM u GROUP BY symbol, weekday""")
def weekday_extremes(spark, sf_dir):
    return show(K.weekday_extremes(event_bars(spark, sf_dir)), ["weekday", "lows", "highs"], [], [])


@register(f"""WITH {EVENT_BARS}, {GREEN}, m AS (SELECT * FROM mt WHERE m), u AS {_trim(DIP, 'm')}, z AS (SELECT m.symbol, round((arg_max({DIP}, open_dt) - any_value(u.mean)) / nullif(any_value(u.std), 0), 2) AS z FROM m JOIN u USING (symbol) GROUP BY m.symbol)
SELECT symbol, CASE WHEN abs(z) < 1 THEN 'normal' WHEN abs(z) < 2 THEN 'unusual' WHEN z IS NOT NULL THEN 'extreme' END AS label, {s6('z')} FROM z""")
def dip_score(spark, sf_dir):
    return show(K.dip_score(_streaks(spark, sf_dir), "matched"), ["label"], ["z"], [])


@register(f"""WITH {EVENT_BARS}, {GREEN}, e AS (SELECT * FROM (SELECT *, {rolled('avg', 'close', 50)} AS ema FROM mt) WHERE m AND close >= ema) SELECT symbol, count(*) AS cases, count(*) FILTER (c1) AS k, count(c1) AS n FROM e GROUP BY symbol""")
def streak_above_mean(spark, sf_dir):
    """The position filter: matches kept only above a mean, after matching."""
    rows = K.next_bars(I.moving_averages(_streaks(spark, sf_dir), (50,))).where(F.col("matched") & (F.col("close") >= F.col("sma_50")))
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("cases"), F.count_if("c1_green").alias("k"), F.count("c1_green").alias("n"))
    return show(out, ["cases", "k", "n"], [], [])
