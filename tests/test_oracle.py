"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import pytest
from conftest import DATA

import oracle
from tallyframe.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    assert oracle.compare(QUERIES[name](spark, DATA), db, SQL[name]) == ""


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
