"""Long frames in constant time per row.

Spark folds a sliding frame anew for each row.  Here a series is cut into segments as long as the frame: a frame that ends
at a bar is the end of one segment and the beginning of the next, so it is put together from what two running windows
(one forward, one backward in the segment) hold at its two ends.  Nothing is subtracted, so sums lose no digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import KEYS, bar_no, series

KINDS = ("max", "min", "sum", "avg", "stddev")


def _segmented(bars: DataFrame, n: int, columns: set[str]) -> DataFrame:
    """Adds _no, _seg, and for each column what is known up to the bar (_f...) and from it on (_b...) in its segment."""
    out = bars.withColumn("_no", bar_no()).withColumn("_seg", F.floor((F.col("_no") - 1) / n))
    for side, order in (("f", F.asc("open_dt")), ("b", F.desc("open_dt"))):
        w = Window.partitionBy(*KEYS, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        of = lambda name, f: {f"_{side}{name}_{c}": f(c).over(w) for c in columns}  # noqa: B023, E731
        out = out.withColumns(of("n", F.count) | of("max", F.max) | of("min", F.min) | of("sum", F.sum) | of("avg", F.avg) | of("var", F.var_pop))
    return out


def _joined(kind: str, f: dict[str, Column], b: dict[str, Column]) -> Column:
    """One figure of the frame made of two parts that do not meet."""
    n = f["n"] + b["n"]
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(f[kind], b[kind])
    if kind == "sum":
        return f["sum"] + b["sum"]
    if kind == "avg":
        return (f["sum"] + b["sum"]) / n
    gap = f["avg"] - b["avg"]
    return F.sqrt((f["var"] * f["n"] + b["var"] * b["n"] + gap * gap * f["n"] * b["n"] / n) / (n - 1))


def _alone(kind: str, f: dict[str, Column]) -> Column:
    if kind == "stddev":
        return F.when(f["n"] > 1, F.sqrt(f["var"] * f["n"] / (f["n"] - 1)))
    return f[kind]


def last_bars(bars: DataFrame, n: int, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``bars`` with a column for each name -> (kind, column) over the last ``n`` bars, null until n bars have a value."""
    columns = {c for _, c in wanted.values()}
    out = _segmented(bars, n, columns)
    start = {(k, c): F.lag(F.col(f"_b{k}_{c}"), n - 1).over(series()) for c in columns for k in ("n", "max", "min", "sum", "avg", "var")}
    out = out.withColumns({f"_s{k}_{c}": v for (k, c), v in start.items()})
    values = {}
    for name, (kind, c) in wanted.items():
        f = {k: F.col(f"_f{k}_{c}") for k in ("n", "max", "min", "sum", "avg", "var")}
        b = {k: F.col(f"_s{k}_{c}") for k in f}
        whole = F.col("_no") % n == 0  # the frame is one segment
        values[name] = F.when(whole & (f["n"] == n), _alone(kind, f)).when(~whole & (f["n"] + b["n"] == n), _joined(kind, f, b))
    return out.select(*bars.columns, *[v.alias(k) for k, v in values.items()])


def next_bars(bars: DataFrame, n: int, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``bars`` with a column for each name -> (max or min, column) over the ``n`` bars after each, cut at the series' end."""
    columns = {c for _, c in wanted.values()}
    out = _segmented(bars, n, columns).withColumn("_last", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))
    ends = {f"_e{k}_{c}": F.lead(f"_f{k}_{c}", n).over(series()) for c in columns for k in ("max", "min")}
    starts = {f"_s{k}_{c}": F.lead(f"_b{k}_{c}", 1).over(series()) for c in columns for k in ("max", "min")}
    final = {f"_z{k}_{c}": F.max_by(f"_f{k}_{c}", "_no").over(Window.partitionBy(*KEYS)) for c in columns for k in ("max", "min")}
    out = out.withColumns(ends | starts | final)
    values = {}
    for name, (kind, c) in wanted.items():
        both = F.greatest if kind == "max" else F.least
        cut = F.col("_no") + n > F.col("_last")
        same = F.floor(F.col("_no") / n) == F.floor((F.col("_last") - 1) / n)  # the next bar is in the last segment
        begin, end, last = (F.col(f"_{x}{kind}_{c}") for x in "sez")
        values[name] = F.when(~cut, both(begin, end)).when(F.col("_no") == F.col("_last"), None).when(same, begin).otherwise(both(begin, last))
    return out.select(*bars.columns, *[v.alias(k) for k, v in values.items()])
