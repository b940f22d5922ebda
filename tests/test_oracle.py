"""Every registered query with SQL is compared to DuckDB at the smallest scale."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_each_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(spark, con, entry.queries()[name], SQL[name], sf_dir) is None


def test_flagship(spark):
    assert entry.entry(spark).count() == 6
