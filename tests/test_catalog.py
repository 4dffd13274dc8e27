"""Every engine query against its SQL on the smallest tables; the driver's entry points."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from uistrata.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return str(v) if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else str(float(v))

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.queries()) <= set(entry.queries())
