"""Every query with a SQL counterpart gives the same rows, whole results compared."""

import os

import pytest
from compare import differences, sql_connection

import __spark_entry__ as entry_module

ORACLES = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def sf_dir(small_dir):
    return os.environ.get("QUERY_SF_DIR", small_dir)


@pytest.fixture(scope="module")
def connection(sf_dir):
    return sql_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, connection, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], connection) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry_module.entry(spark).count() > 0
