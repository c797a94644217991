"""Every query that SQL can express, compared with the SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = compare.spark_table(QUERIES[name](spark, DATA))
    want = compare.duck_table(duck, SQL[name])
    assert compare.difference(got, want) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
