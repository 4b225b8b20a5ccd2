"""Every registered query against its SQL twin."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, folder, con, name):
    assert compare(QUERIES[name](spark, folder), con.sql(SQL[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_twins_have_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5
    amounts = [r["total_amount"] for r in rows]
    assert amounts == sorted(amounts, reverse=True)
