"""Joins along time: as-of, and each event with the bars that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import KEYS


#: Days of a series that an as-of join takes in one task.
BUCKET_DAYS = 32


def asof(left: DataFrame, right: DataFrame, columns: list[str], suffix: str, by: tuple[str, ...] = ("symbol",), days: int = BUCKET_DAYS) -> DataFrame:
    """``left`` with the ``columns`` (named {column}_{suffix}) of the last ``right`` row at or before its open_dt.

    Both sides are stacked and carried forward in a window, so no pair of rows is made.  Windows are buckets of some days,
    so that one long series spreads over many tasks: each bucket begins with the last right row before it, which is
    carried over buckets (a row each) first.  A matched row's nulls are kept; a left row before the first right row has
    nulls.
    """
    match = F.struct(*[F.col(c).alias(f"{c}_{suffix}") for c in columns])
    bucket = F.floor(F.unix_date(F.to_date("open_dt")) / days).alias("_bucket")
    r = right.select(*by, bucket, "open_dt", F.lit(1).alias("_side"), match.alias("_match"))
    kind = r.schema["_match"].dataType
    row = F.struct(*[F.col(c) for c in left.columns])
    lefts = left.select(*by, bucket, "open_dt", F.lit(2).alias("_side"), F.lit(None).cast(kind).alias("_match"), row.alias("_row"))
    ends = r.groupBy(*by, "_bucket").agg(F.max_by("_match", "open_dt").alias("_match"))
    ends = ends.union(left.select(*by, bucket, F.lit(None).cast(kind).alias("_match")).distinct())
    ends = ends.groupBy(*by, "_bucket").agg(F.first("_match", ignorenulls=True).alias("_match"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_bucket", F.lit(None).cast(left.schema["open_dt"].dataType).alias("open_dt"), F.lit(0).alias("_side"), F.last("_match", ignorenulls=True).over(before).alias("_match"))
    none = F.lit(None).cast(lefts.schema["_row"].dataType)
    both = lefts.unionByName(r.withColumn("_row", none)).unionByName(carried.where("_match IS NOT NULL").withColumn("_row", none))
    w = Window.partitionBy(*by, "_bucket").orderBy(F.col("open_dt").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_match", F.last("_match", ignorenulls=True).over(w))
    return both.where("_side = 2").select("_row.*", "_match.*")


def follow(events: DataFrame, bars: DataFrame, first: int, last: int, columns: list[str], keys: list[str] = KEYS) -> DataFrame:  # noqa: B006
    """One row for each event and each bar ``first`` to ``last`` after it: event columns, ``offset`` and f_{column}.

    Both sides need ``keys`` (the series, or more where a series has several runs; nulls match nothing) and bar_no.  Bars fall into runs as long as the horizon and an event meets two of
    them, so this is an equi-join on (series, run): work follows events times horizon, and one long series spreads over
    many tasks.
    """
    width = last - first + 1
    run = lambda no: F.floor(no / F.lit(width)).cast("long")
    e = events.withColumn("_run", F.explode(F.sequence(run(F.col("bar_no") + first), run(F.col("bar_no") + last))))
    b = bars.select(*keys, F.col("bar_no").alias("_no"), run(F.col("bar_no")).alias("_run"), *[F.col(c).alias(f"f_{c}") for c in columns])
    pairs = e.join(b, [*keys, "_run"]).withColumn("offset", (F.col("_no") - F.col("bar_no")).cast("int"))
    return pairs.where(F.col("offset").between(first, last)).drop("_run", "_no")


def semi(bars: DataFrame, times: DataFrame) -> DataFrame:
    """Bars whose (symbol, open_dt) is in ``times``."""
    return bars.join(times.select("symbol", "open_dt"), ["symbol", "open_dt"], "left_semi")
