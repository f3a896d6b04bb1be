"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from tidemark.queries import all_oracles, all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    """The training-data queries may do without; those are tested by brute force beside their operators."""
    assert set(all_queries()) == set(all_oracles())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, connection, name):
    assert difference(spark, connection, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None
