"""Every query against its SQL, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import rows
from contract.oracle import ORACLE
from contract.queries import QUERIES
from contract.views import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, database, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    want = database.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
