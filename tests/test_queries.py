"""Every registered query against its SQL on the smallest test data."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, FOLDER, QUERIES[name], SQL.get(name), con) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 6
    assert set(SQL) <= set(QUERIES)
