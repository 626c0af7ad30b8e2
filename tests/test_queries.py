"""Queries of every area against their SQL on the smallest tables, and the registry itself."""

import pytest

from hazegrid.plans import registry
from tests.oracle import same

@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    assert same(spark, registry.QUERIES[name], registry.ORACLES[name]) > 0 or name == "c1_unresolved"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
