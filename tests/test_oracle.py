"""Every query with a SQL twin gives the same rows as DuckDB."""

import pytest
from oracle_check import connect, differences, duck_rows, spark_rows

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, small, duck, name):
    result = spark_rows(QUERIES[name](spark, small))
    assert differences(result, duck_rows(duck, ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    row = entry.entry(spark).first()
    assert (row["n_name"], row["total"]) == ("NATION_19", 26622544.97)


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)
