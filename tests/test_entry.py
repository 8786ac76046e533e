"""The driver's contract: names, columns, and SQL beside queries on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from screenloom.plans import registry


def value(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, (list, np.ndarray)):
        return [value(x) for x in v]
    return pd.Timestamp(v) if hasattr(v, "year") else v


def rows(df):
    return sorted(str([value(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, sf, con, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), con.execute(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles()) - {"p6_found"}))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
