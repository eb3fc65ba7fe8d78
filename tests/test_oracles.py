"""Every query against its SQL twin in DuckDB."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _cell(x):
    if pd.isna(x):
        return None
    if isinstance(x, float):
        return float(x)
    if isinstance(x, bool | np.bool_):
        return bool(x)
    return int(x) if hasattr(x, "__index__") else x


def _rows(df):
    return sorted(repr(tuple(map(_cell, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_counts(spark):
    """Three green bars: cases, green next bars, next bars."""
    got = {r.symbol: (r.cases, r.k, r.n) for r in QUERIES["streak_c1"](spark, SF).collect()}
    assert got == {"click": (46, 18, 46), "error": (68, 36, 68), "purchase": (52, 18, 51), "signup": (42, 14, 42), "view": (39, 11, 38)}
