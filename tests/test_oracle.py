"""Every query that has SQL gives the same rows in DuckDB."""

import compare
import pytest

import __spark_entry__ as entry
from keytally.plans.catalogue import all_queries
from keytally.plans.oracle import all_sql

QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare.difference(result, duck, SQL[name]) is None
    else:
        assert result.count() > 0


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["seq", "key", "n"]
    assert result.count() > 0
