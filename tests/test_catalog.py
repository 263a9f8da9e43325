"""Every named query against its SQL twin on the smallest shared tables."""

import os

import pytest

from newsloom.catalog import QUERIES, TWINS

from compare import connect, spark_rows, twin_rows

FOLDER = os.environ.get("NEWSLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, connection, name):
    columns, rows = spark_rows(QUERIES[name](spark, FOLDER))
    twin_columns, twin = twin_rows(connection, TWINS[name])
    assert columns == twin_columns
    assert rows == twin


def test_entry(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).limit(1).count() == 1
