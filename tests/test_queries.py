"""Every query runs; those with SQL agree with DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from axonwave import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(df):
    key = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return Counter(tuple(key(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_oracles_are_of_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
