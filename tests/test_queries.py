"""Every query against its DuckDB twin on the smallest data set."""

import os

import pytest

from checks.compare import differences, duck
from checks.oracle import oracle_sql
from checks.registry import QUERIES, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(oracle_sql()) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    result = queries()[name](spark, SF_DIR).toPandas()
    assert len(result) > 0
    assert differences(result, connection.sql(oracle_sql()[name]).df()) is None
