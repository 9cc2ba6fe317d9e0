"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from locusframe.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for name in os.listdir(SMALL):
        c.sql(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return c


def rows(frame, names):
    clean = lambda x: None if x is None or x != x else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(clean(x) for x in r) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    found, wanted = entry.queries()[name](spark, SMALL).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    assert rows(found, names) == rows(wanted, names)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0
