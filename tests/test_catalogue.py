"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from collectra import catalogue


def rows(df: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        return int(x) if hasattr(x, "__int__") and not isinstance(x, (str, bool)) and float(x) == int(x) else x

    return sorted(repr(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
