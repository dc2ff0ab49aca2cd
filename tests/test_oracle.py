"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

import checks.catalog  # noqa: F401
from checks.compare import compare, open_tables
from checks.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees_with_sql(spark, tables, name):
    assert compare(spark, tables, SF, name) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(SQL) > 150
