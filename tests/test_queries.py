"""Every registered query against its SQL on DuckDB."""

import pytest

import compare
from seqrec.checks import REGISTRY


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", [n for n, c in REGISTRY.items() if c.sql])
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert compare.differences(REGISTRY[name].run(spark, sf_dir), duck, REGISTRY[name].sql) == []


@pytest.mark.parametrize("name", [n for n, c in REGISTRY.items() if not c.sql])
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert REGISTRY[name].run(spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
