"""Every query with a SQL counterpart, on the whole tables."""

import oracle
import pytest

import __spark_entry__ as entry_point

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, name, QUERIES[name], SQL[name], sf) is None


def test_entry_has_rows(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and "l_orderkey" in df.columns


def test_sql_names_are_registered():
    assert set(SQL) <= set(QUERIES)
