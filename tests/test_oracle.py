"""Every registered query against its DuckDB twin on the whole test tables."""

import pytest

import __spark_entry__ as entry_module
from compare import assert_same, connect
from examlens.plans import catalog, oracles

QUERIES = catalog.queries()
ORACLE = oracles.oracle_sql()

# Spark type name: DuckDB type name.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLE[name])
    kinds = {c: TYPES[k] for c, k in found.dtypes}
    assert kinds == {c: str(k) for c, k in zip(expected.columns, expected.types)}
    assert assert_same(found, expected) > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
