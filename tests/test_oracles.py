"""Every query that has SQL must agree with it, values and types, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.database(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert oracle.differences(entry.queries()[name](spark, SF_DIR), con, SQL[name]) == []
