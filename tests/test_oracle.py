"""Every query with a SQL twin gives the same rows as DuckDB; every other one runs."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from firnline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def keyed(df: pd.DataFrame) -> list[tuple]:
    """Rows as tuples, sorted by what is not rounded and then by what is."""
    df = df[sorted(df.columns)]
    rows = [tuple(None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else float(x) if isinstance(x, (float, np.floating)) else bool(x) if isinstance(x, (bool, np.bool_)) else int(x) if isinstance(x, (int, np.integer)) else str(x) for x in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: [(x is not None, round(x, 3) if isinstance(x, float) else x) if not isinstance(x, bool) else (True, int(x)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = keyed(got), keyed(want)
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b) if not close(x, y)]
    left = [y for _, y in off]
    for x, _ in off:  # rows that rounding has put into another order
        same = next((k for k, y in enumerate(left) if close(x, y)), None)
        assert same is not None, (x, off[:3])
        left.pop(same)


def close(x: tuple, y: tuple) -> bool:
    return all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-4)) for p, q in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
