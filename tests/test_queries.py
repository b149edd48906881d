"""Every registered query against its SQL on the smallest data."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SMALL, queries()[name], SQL.get(name))
    assert ok, message


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(queries())
