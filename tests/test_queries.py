"""Every query that has an SQL statement against that statement, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = entry.SMOKE_FOLDER
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, SQL[name]) is None
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() == 150
