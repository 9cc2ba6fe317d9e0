"""The registered corpus queries with SQL give DuckDB's rows on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from locusframe.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_queries import SMALL, rows  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.sql(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    found, wanted = entry.queries()[name](spark, SMALL).toPandas(), duck.sql(queries.ORACLES[name]).df()
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    assert rows(found, names) == rows(wanted, names)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_has_a_row_for_each_document(spark, name):
    found = entry.queries()[name](spark, SMALL)
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert found.select("doc_id").distinct().count() == documents
