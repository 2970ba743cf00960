"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog import oracle, spark_queries
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(spark_queries.REGISTRY) == set(oracle.SQL)
    assert set(oracle.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(spark_queries.REGISTRY))
def test_same_rows(spark, duck, name):
    assert difference(spark, duck, FOLDER, entry.queries()[name],
                      entry.oracle_sql()[name]) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["query_id", "volume", "path", "score", "rank"]
    assert result.count() > 0
