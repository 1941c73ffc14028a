"""Every query with SQL against DuckDB, and every other one for rows and schema."""

from __future__ import annotations

import pytest
from oracle import difference, duck

from plaudit import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def registry(spark):
    return catalog.queries(), catalog.oracle_sql()


def test_all_same_as_sql(spark, con, registry):
    queries, oracle = registry
    wrong = {}
    for name, sql in oracle.items():
        found = difference(queries[name](spark, SF), con, sql)
        if found:
            wrong[name] = found
    assert not wrong


def test_others_give_rows(spark, registry):
    queries, oracle = registry
    for name in sorted(set(queries) - set(oracle)):
        df = queries[name](spark, SF)
        assert df.take(1), name
        assert len(set(df.columns)) == len(df.columns)


def test_sql_belongs_to_queries(registry):
    queries, oracle = registry
    assert set(oracle) <= set(queries)
