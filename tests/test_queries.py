"""Every registered query that has SQL gives the rows of that SQL."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = oracle(SMALL)
    yield connection
    connection.close()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, SMALL, name, QUERIES[name], SQL[name]) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    rates = [r["persentase_tertinggal"] for r in rows]
    assert len(rows) == 10 and rates == sorted(rates, reverse=True)
