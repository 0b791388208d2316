"""Every named query against its SQL counterpart, row by row."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference
from tests.conftest import DATA

SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, DATA), duck, SQL[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_comparison_sees_differences(spark, duck):
    df = QUERIES["loan_status_breakdown"](spark, DATA)
    sql = SQL["loan_status_breakdown"]
    assert difference(df.limit(2), duck, sql) is not None
    assert difference(df.withColumnRenamed("count", "n"), duck, sql) is not None
