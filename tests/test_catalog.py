"""Every registered query against its SQL at the smallest scale."""

import pytest

from oncolattice.catalog import ORACLE, QUERIES
from tests.oracle_compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, sf, con, key):
    assert compare(spark, con, sf, key, QUERIES[key], ORACLE.get(key)) is None


def test_entry(spark, sf):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
