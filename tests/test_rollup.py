"""Rollups from day rows against the same figures from the ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import rollup as R


def _ticks(spark):
    return spark.sql("SELECT if(id % 4 = 0, 'A', 'B') AS s, timestamp_seconds(1704067200 + id * 600) AS ts, if(id % 50 = 7, NULL, (id * 7919) % 10007 / 10.0) AS v, (id * 31) % 3000 AS u FROM range(20000)")


def test_levels_add_up_exactly_and_sketches_nearly(spark):
    ticks = _ticks(spark)
    days = R.day_rows(ticks, ["s"], "ts", "v", "u")
    got = {(r.s, str(r.period)): r for r in R.estimated(R.merged(days, ["s"]), (0.1, 0.5)).collect()}
    known = ticks.where("v IS NOT NULL").withColumn("m", F.date_trunc("month", "ts").cast("date").cast("string"))
    for keys in (["s", "m"], ["s"], ["m"], []):
        exact = known.groupBy(*keys).agg(F.count("v").alias("n"), F.sum("v").alias("t"), F.count_distinct("u").alias("d"), F.percentile("v", [0.05, 0.15, 0.45, 0.55]).alias("q"))
        for e in exact.collect():
            r = got.pop((e["s"] if "s" in keys else None, e["m"] if "m" in keys else "None"))
            assert r.level == ",".join("period" if k == "m" else k for k in keys)
            assert r.n == e.n and abs(r.total - float(e.t)) < 1e-6 * float(e.t)
            assert abs(r.n_distinct - e.d) <= 0.08 * e.d
            assert e.q[0] <= r.p10 <= e.q[1] and e.q[2] <= r.p50 <= e.q[3]
    assert not got


def test_days_merge_in_any_order_and_an_empty_table_has_no_days(spark):
    days = R.day_rows(_ticks(spark), ["s"], "ts", "v", "u")
    parts = days.where("day < '2024-02-01'").unionByName(days.where("day >= '2024-02-01'").orderBy(F.desc("day")))
    exact = lambda d: sorted(map(str, R.merged(d, ["s"], "year").select("s", "period", "n", "least", "most").collect()))
    assert exact(parts) == exact(days)
    assert R.day_rows(_ticks(spark).limit(0), ["s"], "ts", "v", "u").count() == 0
