"""Every registered query runs; those with SQL must give the same rows, names and types."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_point
from riskloom.plans.queries import QUERIES, oracle_sql


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, data, name):
    assert difference(spark, con, name, data) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle_sql())))
def test_query_without_sql_has_rows(spark, data, name):
    assert not QUERIES[name](spark, data).isEmpty()


def test_entry_point(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).columns[:2] == ["GEOID", "t0"]
