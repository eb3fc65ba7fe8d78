"""OHLCV bars: readers, building bars from ticks, resampling and checks.

A bar table has symbol, interval, open_dt (TIMESTAMP_NTZ), open, high, low, close, volume; (symbol, interval, open_dt)
is unique.  Everything else in the library keeps one DataFrame for all series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
#: Minutes of each interval name (fixed values).
INTERVALS = {"1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "8h": 480, "12h": 720, "1d": 1440, "3d": 4320, "1w": 10080, "1M": 43200}

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("interval", T.StringType()), T.StructField("open_dt", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume")]
)
#: Names of the time column that a file may use (fixed values).
TIMES = ("open_time", "open_dt", "datetime")


def epoch_time(t: Column) -> Column:
    """Time of an epoch in milliseconds or microseconds (the bound between them is a fixed value)."""
    return F.timestamp_millis(F.when(t > 2_000_000_000_000, F.floor(t / 1000)).otherwise(t).cast("long")).cast("timestamp_ntz")


def bars_from_ticks(ticks: DataFrame, symbol: str, ts: str, value: str, tie: str, unit: str = "hour", interval: str = "1h") -> DataFrame:
    """Bars by symbol and time unit; first and last by (ts, tie).  One partial aggregation, one shuffle of bars."""
    order = F.struct(ts, tie)
    return (
        ticks.where(F.col(value).isNotNull())
        .groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("open_dt"))
        .agg(
            F.min_by(value, order).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, order).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.lit(interval).alias("interval"), "open_dt", *PRICES, "volume")
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of ``events``, a series for each event type."""
    return bars_from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, a series for each priority."""
    return bars_from_ticks(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "day", "1d")


def part_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of line prices, a series for each part: many short series."""
    ticks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("symbol", F.col("l_partkey").cast("string")).withColumn("tie", F.struct("l_orderkey", "l_linenumber"))
    return bars_from_ticks(ticks, "symbol", "l_shipdate", "l_extendedprice", "tie", "week", "1w")


#: A comma with an even number of quotes after it.
_OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files named ``{COIN}USDT-{interval}-merged.csv``; symbol and interval come from the name.

    Each file's own header says which column is which, in any order, spelling and spacing of letters aside; others are
    ignored.  Times are epochs or timestamps under one of the names ``TIMES``.  A file that lacks a column is an error.
    A comma between quotes does not end a cell.
    """
    cells = F.when(F.contains("value", F.lit('"')), F.split("value", _OUTSIDE_QUOTES)).otherwise(F.split("value", ","))
    parts = F.transform(cells, lambda x: F.btrim(x, F.lit(' "\t\r\ufeff')))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), parts.alias("cells"))
    names = F.transform("cells", lambda x: F.lower(x))
    is_header = F.arrays_overlap(names, F.array(*map(F.lit, TIMES)))
    headers = lines.groupBy("file").agg(F.max(F.when(is_header, names)).alias("names"))
    needed = F.array(*[F.lit(c) for c in (*PRICES, "volume")])
    headers = headers.withColumn("missing", F.when(F.col("names").isNull(), F.array(F.lit("open_time"))).otherwise(F.array_except(needed, "names"))).cache()
    if bad := headers.where(F.size("missing") > 0).limit(3).collect():
        raise ValueError(f"missing columns: {[(r.file, r.missing) for r in bad]}")

    def cell(name: str) -> Column:
        return F.get(F.col("cells"), (F.array_position("names", F.lit(name)) - 1).cast("int"))

    rows = lines.where(~is_header).join(headers.select("file", "names"), "file")  # a header for each file
    time = F.coalesce(*[F.when(F.array_contains("names", F.lit(t)), cell(t)) for t in TIMES])
    known = r"([^/]+)USDT-([^/]+)-merged\.csv$"  # fixed value: how files are named
    interval = F.regexp_extract("file", known, 2)
    number = lambda c: cell(c).try_cast("double")
    bars = rows.select(
        F.upper(F.regexp_extract("file", known, 1)).alias("symbol"),
        F.when(interval == "1mo", "1M").otherwise(interval).alias("interval"),
        F.coalesce(epoch_time(time.try_cast("bigint")), time.try_cast("timestamp_ntz")).alias("open_dt"),
        *[number(c).alias(c) for c in (*PRICES, "volume")],
    )
    return first_per_bar(bars.where("open_dt IS NOT NULL"))


def time_index(df: DataFrame) -> DataFrame:
    """``df`` with its time column, under one of the names ``TIMES``, as open_dt; rows without a time are left out."""
    found = [c for c in df.columns if c.strip().lower() in TIMES]
    if not found:
        raise ValueError(f"none of the columns {TIMES}")
    kind = df.schema[found[0]].dataType
    time = epoch_time(F.col(f"`{found[0]}`")) if isinstance(kind, T.IntegralType) else F.col(f"`{found[0]}`").cast("timestamp_ntz")
    rest = [F.col(f"`{c}`") for c in df.columns if c != found[0] and c != "open_dt"]
    return df.select(time.alias("open_dt"), *rest).where("open_dt IS NOT NULL")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA).parquet(path)


def write_parquet(bars: DataFrame, path: str) -> None:
    """Bars laid out by symbol and interval, so that filters on them prune folders."""
    bars.repartition("symbol", "interval").write.partitionBy("symbol", "interval").mode("overwrite").parquet(path)


class NoBars(ValueError):
    """None of the paths exists, or none has enough bars."""


def load(spark: SparkSession, paths: list[str], min_rows: int = 1) -> DataFrame:
    """Bars of the first path that has some; ``NoBars`` if none has."""
    for path in paths:
        try:
            bars = read_csv(spark, path) if path.endswith(".csv") else read_parquet(spark, path)
            if len(bars.limit(min_rows).collect()) >= min_rows:
                return bars
        except Exception as error:  # a missing path is tried past; anything else is not
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise NoBars(f"no bars in {paths}")


def load_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The bars of all paths that exist, one row per bar; ``NoBars`` if none exists.  A file that cannot be read is an error."""
    found = []
    for path in paths:
        try:
            found.append(load(spark, [path], 0).select(*BAR_SCHEMA.names))
        except NoBars:
            continue
    if not found:
        raise NoBars(f"no bars in {paths}")
    out = found[0]
    for bars in found[1:]:
        out = out.union(bars)
    return first_per_bar(out)


def first_per_bar(bars: DataFrame) -> DataFrame:
    """One row per bar: of repeated ones that with the smallest prices, so the choice does not depend on row order."""
    w = Window.partitionBy("symbol", "interval", "open_dt").orderBy(*PRICES, "volume")
    return bars.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resample(bars: DataFrame, rule: str, interval: str) -> DataFrame:
    """Coarser bars; empty ones do not appear.  Times without zone are binned as they are, in any session's zone."""
    start = F.window(F.col("open_dt").cast("timestamp_ntz"), rule)["start"]
    return (
        bars.groupBy("symbol", start.alias("start"))
        .agg(
            F.min_by("open", "open_dt").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_dt").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.lit(interval).alias("interval"), F.col("start").alias("open_dt"), *PRICES, "volume")
    )


def violations(bars: DataFrame) -> DataFrame:
    """Bars that cannot be: a price missing or no number, high under low, or open or close outside them."""
    o, h, low, c = (F.col(x) for x in PRICES)
    bad = F.when(F.greatest(*[(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).cast("int") for x in (o, h, low, c)]) == 1, "not finite")
    bad = bad.when(h < low, "high under low").when((o > h) | (o < low), "open outside").when((c > h) | (c < low), "close outside")
    return bars.withColumn("violation", bad).where("violation IS NOT NULL")


def require_columns(df: DataFrame, columns: list[str], min_rows: int = 0) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if min_rows and len(df.limit(min_rows).collect()) < min_rows:
        raise ValueError(f"fewer than {min_rows} rows")
    return df


def timeframes(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, interval, minutes) of a bar table's folders, shortest first."""
    minutes = F.element_at(F.create_map(*[F.lit(x) for kv in INTERVALS.items() for x in kv]), F.col("interval"))
    return spark.read.parquet(path).select("symbol", "interval").distinct().withColumn("minutes", minutes).orderBy("symbol", "minutes")


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Rows of page ``number`` (from 1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """One row: total rows, and pages of ``size`` rows."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which each of the ``columns`` that exist has a value that is a number where it should be one."""
    kinds = dict(df.dtypes)
    good = F.lit(True)
    for c in (c for c in columns if c in kinds):
        good = good & F.col(f"`{c}`").isNotNull() & (~F.isnan(f"`{c}`") if kinds[c] in ("double", "float") else F.lit(True))
    return df.where(good)


def sane_json(df: DataFrame) -> DataFrame:
    """(json) of each row, with null for what JSON cannot say: NaN and infinities."""
    kinds = dict(df.dtypes)
    number = lambda c: F.when(~F.isnan(f"`{c}`") & (F.abs(F.col(f"`{c}`")) != float("inf")), F.col(f"`{c}`"))
    fields = [(number(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`")).alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def export(bars: DataFrame, source: str, last: int = 500) -> DataFrame:
    """Per series: its last bars in order as JSON records, how many, and where they come from."""
    w = Window.partitionBy("symbol", "interval").orderBy(F.desc("open_dt"))
    rows = bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    record = F.struct("open_dt", *PRICES, "volume")
    out = rows.groupBy("symbol", "interval").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("records"), F.count(F.lit(1)).alias("n_records"))
    return out.withColumn("source", F.lit(source))
