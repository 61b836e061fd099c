"""Every registered query against its oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from checks import suites
from checks.views import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = suites.QUERIES, suites.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def shown(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value + 0.0 if isinstance(value, float) else value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, result.fetchall())


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()
