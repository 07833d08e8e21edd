"""Every registered query with SQL equals DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from gridloom.plans.all_queries import ORACLES, QUERIES
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 4
