"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert differences(df, con, SQL[name]) is None
    else:
        assert not df.isEmpty()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 50
    assert rows == sorted(rows, key=lambda r: (-r["hits"], r["src_ip"]))


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
