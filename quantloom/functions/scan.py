"""Linear recurrences as block scans: exponential means and what builds on them, in DataFrame functions only.

An exponential mean is y' = a y + b, and such steps compose: a block of bars is one step too.  So a series is cut into
blocks by date (and these into runs of at most ``BLOCK`` bars), which spread over all tasks:

1. Inside a run, y = P (y1 + sum of b / P) with the running product P of a, both plain running windows.
2. A run's length, first value, lead, product and sum make one small row; the rows of a series are folded in order, which
   gives the mean that each run starts from.  Only these rows of a series, one for some 256 bars, meet in one task.
3. Runs take their start by a join on (series, block), and a second pass applies it.

What compares a bar with the one before it (gains, ranges) is known inside a run but for its first bar; the small rows carry
their first and last bars, so the fold adds that one value.

A value that is missing leaves the mean as it is and weighs the next value more: after g bars the mean counts
(1 - alpha)**g against alpha.  NaN counts as missing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import KEYS, full, roll
from quantloom.sources.bars import INTERVALS

#: Bars in a run, about and at most.  Products of 256 factors stay far from the least double for means of two bars or more.
BLOCK = 256
_DAY = 1440
_RUN = [*KEYS, "_block", "_part"]


#: What means of moves compare between a bar, {c}, and the one before it, {p}.
GAIN = "greatest({c}_close - {p}_close, 0D * ({c}_close - {p}_close))"
LOSS = "greatest({p}_close - {c}_close, 0D * ({c}_close - {p}_close))"
TRUE_RANGE = "greatest({c}_high - {c}_low, abs({c}_high - {p}_close), abs({c}_low - {p}_close))"
PLUS = "CASE WHEN {c}_high - {p}_high > {p}_low - {c}_low AND {c}_high - {p}_high > 0 THEN {c}_high - {p}_high ELSE 0D END"
MINUS = "CASE WHEN {p}_low - {c}_low > {c}_high - {p}_high AND {p}_low - {c}_low > 0 THEN {p}_low - {c}_low ELSE 0D END"
_BAR = ("_close", "_high", "_low")


@dataclass(frozen=True)
class Mean:
    """An exponential mean of a column, or of a move: its name, its weight of a new value, and the values it needs to show."""

    name: str
    of: str
    alpha: float
    least: int = 1

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 0.9:
            raise ValueError(f"alpha of {self.name} must be above 0 and at most 0.9: {self.alpha}")

    @property
    def moves(self) -> bool:
        return "{p}" in self.of


def ema(name: str, of: str, span: int) -> Mean:
    return Mean(name, of, 2 / (span + 1))


def rma(name: str, of: str, n: int) -> Mean:
    """Wilder's mean: null until n values were seen."""
    return Mean(name, of, 1 / n, n)


def blocked(bars: DataFrame) -> DataFrame:
    """Adds _block (by date, as wide as ``BLOCK`` bars of the interval, a day at least), _part and _no (from 1) in it."""
    days = F.element_at(F.create_map(*[F.lit(x) for k, v in INTERVALS.items() for x in (k, max(1, v * BLOCK // _DAY))]), F.coalesce("interval", F.lit("")))
    out = bars.withColumn("_block", F.floor(F.unix_date(F.to_date("open_dt")) / F.coalesce(days, F.lit(1))))
    place = F.row_number().over(Window.partitionBy(*KEYS, "_block").orderBy("open_dt")) - 1
    out = out.withColumn("_part", F.floor(place / BLOCK).cast("int"))
    return out.withColumn("_no", F.row_number().over(_inside()))


def unblocked(bars: DataFrame) -> DataFrame:
    return bars.drop("_block", "_part", "_no")


def _inside():
    return Window.partitionBy(*_RUN).orderBy("open_dt")


def _given(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` with the column _start that ``starts`` has for their run; one small row per block is joined."""
    per_block = starts.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate((*KEYS, "_block"))]).agg(F.sort_array(F.collect_list(F.struct("_part", "_start"))).alias("_starts"))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate((*KEYS, "_block"))])
    joined = rows.join(per_block, same, "left").withColumn("_start", F.get("_starts._start", F.col("_part")))
    return joined.drop("_starts", *[f"_k{i}" for i in range(3)])


# Expressions are written as SQL text here: a mean has dozens, and a parsed text is one call instead of as many.


def _first(mean: Mean, state: str, x1: str, lead: str) -> str:
    """The mean at a run's first value, ``lead`` bars into it, from the state (y, gap, n) before the run."""
    old = f"power({1 - mean.alpha!r}D, {state}.gap + {lead} + 1)"
    return f"CASE WHEN {state}.y IS NULL THEN {x1} ELSE ({old} * {state}.y + {mean.alpha!r}D * {x1}) / ({old} + {mean.alpha!r}D) END"


def _next(mean: Mean, state: str, run: str) -> str:
    """The state after a run; y is null until a value was seen."""
    y = f"CASE WHEN {run}.n = 0 THEN {state}.y ELSE {run}.p * ({_first(mean, state, f'{run}.x1', f'{run}.lead')} + {run}.s) END"
    return f"named_struct('y', {y}, 'gap', CASE WHEN {run}.n = 0 THEN {state}.gap + {run}.rows ELSE {run}.tail END, 'n', {state}.n + {run}.n)"


def _opened(mean: Mean, state: str, x: str) -> str:
    """The state after a run's first bar, whose move is ``x``."""
    y = f"CASE WHEN {x} IS NULL THEN {state}.y ELSE {_first(mean, state, x, '0')} END"
    return f"named_struct('y', {y}, 'gap', CASE WHEN {x} IS NULL THEN {state}.gap + 1 ELSE 0L END, 'n', {state}.n + CASE WHEN {x} IS NULL THEN 0L ELSE 1L END)"


def _states(mean: Mean, runs: str) -> str:
    """The state that each of a series' runs starts from.  Two levels, so that no array grows element by element beyond 256.

    For a mean of moves a run starts after its first bar.
    """
    none = "named_struct('y', CAST(NULL AS DOUBLE), 'gap', 0L, 'n', 0L)"
    empty = "CAST(array() AS ARRAY<STRUCT<y: DOUBLE, gap: BIGINT, n: BIGINT>>)"
    start = (lambda s, r: _opened(mean, s, f"{r}.x0")) if mean.moves else (lambda s, r: s)
    after = lambda s, r: f"element_at(transform(array({start(s, r)}), t -> {_next(mean, 't', r)}), 1)"
    grown = lambda over, state, out, step: f"aggregate({over}, named_struct('out', {empty}, 'at', {state}), (a, x) -> named_struct('out', concat(a.out, array({out})), 'at', {step}), a -> a.out)"
    chunks = f"transform(sequence(0, CAST(floor((size({runs}) - 1) / 256) AS INT)), i -> slice({runs}, i * 256 + 1, 256))"
    heads = grown(chunks, none, "a.at", f"aggregate(x, a.at, (s, r) -> {after('s', 'r')})")
    return f"flatten(zip_with({chunks}, {heads}, (c, h) -> {grown('c', 'h', start('a.at', 'x'), after('a.at', 'x'))}))"


def with_means(rows: DataFrame, means: list[Mean]) -> DataFrame:
    """``blocked`` bars with each mean as a column; all means share one exchange, one sort and one join."""
    names, moving = list(enumerate(means)), any(m.moves for m in means)
    inside = f"PARTITION BY {', '.join(_RUN)} ORDER BY open_dt"
    frame = f"{inside} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    here, before = f"OVER ({frame} CURRENT ROW)", f"OVER ({frame} 1 PRECEDING)"
    with_ = lambda df, columns: df.selectExpr("*", *columns)
    bar = [c for c in _BAR if c in rows.columns]
    out = with_(rows, [f"lag({c}) OVER ({inside}) AS _p{c}" for c in bar]) if moving else rows
    of = lambda m: f"CASE WHEN _no > 1 THEN {m.of.format(c='', p='_p')} END" if m.moves else f"CASE WHEN NOT isnan({m.of}) THEN CAST({m.of} AS DOUBLE) END"
    out = with_(out, [f"{of(m)} AS _x{i}" for i, m in names])
    out = with_(out, [f"_no - max(CASE WHEN _x{i} IS NOT NULL THEN _no END) {before} AS _g{i}" for i, _ in names])
    steps = []
    for i, m in names:
        q = f"CASE WHEN _g{i} = 1 THEN {1 - m.alpha!r}D ELSE power({1 - m.alpha!r}D, _g{i}) END"
        later = f"_x{i} IS NOT NULL AND _g{i} IS NOT NULL"
        steps += [f"CASE WHEN {later} THEN {q} / ({q} + {m.alpha!r}D) ELSE 1D END AS _a{i}", f"CASE WHEN {later} THEN {m.alpha!r}D * _x{i} / ({q} + {m.alpha!r}D) ELSE 0D END AS _b{i}"]
    out = with_(out, steps)
    running = Window.partitionBy(*_RUN).orderBy("open_dt").rowsBetween(Window.unboundedPreceding, 0)
    out = out.select("*", *[F.product(F.col(f"_a{i}")).over(running).alias(f"_p{i}") for i, _ in names])
    # Bars before the first value; the first bar of a run is not among them where the fold adds its move.
    sums = "sum(_b{0} / _p{0}) {1} AS _s{0}", "count(_x{0}) {1} AS _n{0}", "first(_x{0}, true) {1} AS _f{0}", "CAST(min(CASE WHEN _x{0} IS NOT NULL THEN _no END) {1} - {2} AS BIGINT) AS _l{0}"
    out = with_(out, [e.format(i, here, 2 if m.moves else 1) for i, m in names for e in sums])
    # A run's own row: all but its first bar is what the windows say at its last one.
    of_run = [
        f"'r{i}', named_struct('rows', CAST(_no AS BIGINT) - {int(m.moves)}, 'n', _n{i}, 'x1', _f{i}, 'lead', _l{i}, 'p', _p{i}, 's', _s{i}, 'tail', CASE WHEN _x{i} IS NOT NULL THEN 0L ELSE CAST(_g{i} AS BIGINT) END)"
        for i, m in names
    ]
    ends = [f"max_by(named_struct({', '.join(of_run)}), _no) AS r"]
    if moving:
        both = f"named_struct({', '.join(f"'{c}', {c}" for c in bar)})"
        ends += [f"min_by({both}, _no) AS o", f"max_by({both}, _no) AS e"]
    runs = out.groupBy(*_RUN).agg(*map(F.expr, ends))
    fields = ", ".join(f"'{c}', {c}" for c in ("_block", "_part", "r", *(("o", "e") if moving else ())))
    runs = runs.groupBy(*KEYS).agg(F.expr(f"sort_array(collect_list(named_struct({fields}))) AS _runs"))
    for i, m in names:
        if m.moves:
            first = m.of.format(c="r.o.", p="get(_runs, j - 1).e.")
            summary = ", ".join(f"'{c}', r.r.r{i}.{c}" for c in ("rows", "n", "x1", "lead", "p", "s", "tail"))
            runs = with_(runs, [f"transform(_runs, (r, j) -> named_struct({summary}, 'x0', {first})) AS _r{i}"])
    runs = with_(runs, [f"{_states(m, f'_r{i}' if m.moves else f'_runs.r.r{i}')} AS _m{i}" for i, m in names])
    of_means = ", ".join(f"'m{i}', get(_m{i}, j)" for i, _ in names)
    starts = runs.select(*KEYS, F.expr(f"inline(transform(_runs, (r, j) -> named_struct('_block', r._block, '_part', r._part, '_start', named_struct({of_means}))))"))
    out = _given(out, starts)
    values = []
    for i, m in names:
        y = f"CASE WHEN _n{i} = 0 THEN _start.m{i}.y ELSE _p{i} * ({_first(m, f'_start.m{i}', f'_f{i}', f'_l{i}')} + _s{i}) END"
        values.append(f"CASE WHEN _start.m{i}.n + _n{i} >= {m.least} THEN {y} END AS {m.name}")
    return out.selectExpr(*[f"`{c}`" for c in rows.columns], *values)


#: Sets of several columns; all others have the column of their name.
COLUMNS = {"macd": ("macd", "macd_signal", "macd_hist"), "stoch_rsi": ("stoch_rsi_k", "stoch_rsi_d"), "rma_state": ("avg_gain", "avg_loss")}
_KINDS = ("ema", "rsi", "atr", "adx")


def _parsed(name: str) -> tuple[str, int | tuple[int, ...]]:
    kind, _, n = name.partition("_")
    if name in COLUMNS:
        return name, 0
    if kind == "signal" and re.fullmatch(r"\d+_\d+_\d+", n):
        return kind, tuple(map(int, n.split("_")))
    if kind not in _KINDS or not n.isdigit():
        raise ValueError(f"unknown recursive column: {name}")
    return kind, int(n)


def recursive(bars: DataFrame, names: list[str]) -> DataFrame:
    """``bars`` with the named recursive columns: ema_n, rsi_n, atr_n, adx_n, macd, stoch_rsi, rma_state, and signal_f_s_n, the
    mean over n of the difference of the means over f and s.

    Means of means (MACD's signal, ADX) take a second scan; all others share the first.  Values that are not there yet
    are null; a missing price leaves the means that need it as they are.
    """
    asked = [_parsed(n) for n in names]
    kinds = {k for k, _ in asked}
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    moves = [n for k, n in asked if k == "rsi"] + [14] * bool(kinds & {"stoch_rsi", "rma_state"})
    ranges = [n for k, n in asked if k in ("atr", "adx")]
    out = blocked(bars.withColumns({f"_{c}": number(c) for c in ("close", *(("high", "low") if ranges else ()))}))
    first = {f"_ema_{n}": ema(f"_ema_{n}", "_close", n) for k, n in asked if k == "ema"}
    first |= {f"_{c}_{n}": rma(f"_{c}_{n}", of, n) for n in moves for c, of in (("gain", GAIN), ("loss", LOSS))}
    first |= {f"_tr_{n}": rma(f"_tr_{n}", TRUE_RANGE, n) for n in ranges}
    first |= {f"_{c}_{n}": rma(f"_{c}_{n}", of, n) for k, n in asked if k == "adx" for c, of in (("plus", PLUS), ("minus", MINUS))}
    signals = [n for k, n in asked if k == "signal"] + [(12, 26, 9)] * ("macd" in kinds)
    first |= {f"_ema_{n}": ema(f"_ema_{n}", "_close", n) for fast, slow, _ in signals for n in (fast, slow)}
    out = with_means(out, list(first.values()))
    second: list[Mean] = []
    columns: dict[str, Column] = {}
    for fast, slow, n in dict.fromkeys(signals):
        columns[f"_line_{fast}_{slow}"] = F.col(f"_ema_{fast}") - F.col(f"_ema_{slow}")
        second.append(ema(f"_signal_{fast}_{slow}_{n}", f"_line_{fast}_{slow}", n))
    for n in {n for k, n in asked if k == "adx"}:
        wide = F.when(F.col(f"_tr_{n}") != 0, F.col(f"_tr_{n}"))
        plus, minus = 100 * F.col(f"_plus_{n}") / wide, 100 * F.col(f"_minus_{n}") / wide
        columns[f"_dx_{n}"] = F.when(plus + minus != 0, 100 * F.abs(plus - minus) / (plus + minus))
        second.append(rma(f"_adx_{n}", f"_dx_{n}", n))
    if second:
        out = with_means(out.withColumns(columns), second)
    values: dict[str, Column] = {}
    for name, (kind, n) in zip(names, asked, strict=True):
        if kind in ("ema", "adx"):
            values[name] = F.col(f"_{kind}_{n}")
        elif kind == "atr":
            values[name] = F.col(f"_tr_{n}")
        elif kind == "rsi":
            values[name] = _index(n)
        elif kind == "macd":
            line, signal = F.col("_line_12_26"), F.col("_signal_12_26_9")
            values |= {"macd": line, "macd_signal": signal, "macd_hist": line - signal}
        elif kind == "signal":
            values[name] = F.col(f"_{name}")
        elif kind == "rma_state":
            values |= {"avg_gain": F.col("_gain_14"), "avg_loss": F.col("_loss_14")}
    if "stoch_rsi" in kinds:
        values["_rsi"] = _index(14)
    out = out.select(*bars.columns, *[c.alias(k) for k, c in values.items()])
    out = _stoch(out) if "stoch_rsi" in kinds else out
    return out.select(*bars.columns, *[c for n in names for c in COLUMNS.get(n, (n,))])


def _index(n: int) -> Column:
    """Wilder's index: 100 g / (g + l) of the mean gain g and mean loss l; 0 where nothing was gained or lost."""
    both = F.col(f"_gain_{n}") + F.col(f"_loss_{n}")
    return F.when(both == 0, F.lit(0.0)).otherwise(100 * F.col(f"_gain_{n}") / both)


def _stoch(bars: DataFrame, n: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    """Adds stoch_rsi_k and stoch_rsi_d: the place of _rsi in its range over n bars, smoothed twice."""
    low, high = (full(f("_rsi").over(roll(n)), F.col("_rsi"), n) for f in (F.min, F.max))
    mean = lambda c, m: full(F.avg(c).over(roll(m)), F.col(c), m)
    out = bars.withColumn("_place", 100 * (F.col("_rsi") - low) / (high - low + 1e-10)).withColumn("stoch_rsi_k", mean("_place", k))
    return out.withColumn("stoch_rsi_d", mean("stoch_rsi_k", d)).drop("_place")
