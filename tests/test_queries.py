"""Every registered query with SQL gives the rows of that SQL."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from rillflow import registry


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, small, con, name):
    assert differences(registry.QUERIES[name](spark, small), con, registry.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "acc"] and df.count() > 0


def test_registry_is_consistent():
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
