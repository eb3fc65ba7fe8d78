"""First passages against a plain walk over the bars."""

from __future__ import annotations

import random

import pytest
from helpers import bars

from pyspark.sql import functions as F

from quantloom.functions.windows import KEYS, bar_no
from quantloom.operators import passage


def _rows(n):
    rng, rows, price = random.Random(n), [], 100.0
    for _ in range(n):
        close = price * (1 + rng.uniform(-0.004, 0.004))
        rows.append((price, max(price, close) * 1.001, min(price, close) * 0.999, close, 1.0, rng.random() < 0.002))
        price = close
    return rows


@pytest.mark.parametrize(("horizon", "width"), [(5, 0.004), (48, 0.01), (800, 0.01), (800, 0.2), (2000, 0.05)])
def test_first_passage_equals_a_walk(spark, horizon, width):
    rows = _rows(2300)
    own = bars(spark, rows, extra="out boolean").withColumns({"bar_no": bar_no()})
    n = len(rows)
    events = own.where("bar_no % 37 = 1 AND bar_no < 2300").select(*KEYS, "bar_no", "close", (F.col("bar_no") + 1).alias("_from"), F.least(F.col("bar_no") + horizon, F.lit(n)).alias("_to"))
    got = passage.first_passage(events, own, horizon, F.col("close") * (1 - width), F.col("close") * (1 + width), ["high", "low"], flag=F.col("out"))
    got = {r.bar_no: (r.met, r.offset, r.f_high, r.f_low) for r in got.collect()}
    want = {}
    for at in range(0, n - 1, 37):
        end = min(at + horizon, n - 1)
        close = rows[at][3]
        hit = next((i for i in range(at + 1, end + 1) if rows[i][2] <= close * (1 - width) or rows[i][1] >= close * (1 + width) or rows[i][5]), None)
        last = end if hit is None else hit
        want[at + 1] = (hit is not None, last - at, rows[last][1], rows[last][2])
    assert got == want
    assert len({m for m, *_ in want.values()}) == 2 or width == 0.2 or horizon == 2000


def test_rows_met_follow_the_logarithm_of_the_horizon(spark):
    """An event of horizon 800 looks at five nodes at most, and goes down one level."""
    assert [passage.levels_for(h) for h in (5, 32, 33, 800, 1024, 1025, 32768)] == [1, 1, 2, 2, 2, 3, 3]
    events = spark.range(0, 5000).select((F.col("id") + 1).alias("_from"), (F.col("id") + 800).alias("_to"))
    most = events.select(F.size(passage.looked_at(2)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 4
    assert spark.range(0, 5000).select((F.col("id") + 1).alias("_from"), (F.col("id") + 30000).alias("_to")).select(F.max(F.size(passage.looked_at(3)))).first()[0] <= 5


def test_missing_prices_and_keys_reach_nothing(spark):
    rows = [(1, 1, 1, 1), (1, 9, 1, 1), (1, 1, 1, 1), (1, 9, 1, 1)]
    own = bars(spark, rows).withColumns({"bar_no": bar_no()}).withColumn("high", F.when(F.col("bar_no") != 2, F.col("high")))
    events = own.where("bar_no = 1").select(*KEYS, "bar_no", F.lit(2).alias("_from"), F.lit(4).alias("_to"))
    go = lambda e: [(r.met, r.offset) for r in passage.first_passage(e, own, 3, F.lit(0.0), F.lit(5.0), ["high"]).collect()]
    assert go(events) == [(True, 3)]
    assert go(events.withColumn("symbol", F.lit(None).cast("string"))) == []
