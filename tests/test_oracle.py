"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES, ORACLE) in (None, "both empty")


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "rows_in", "rows_kept", "chars"]


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
