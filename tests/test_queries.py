"""Every registered query: against DuckDB where it has SQL, and that it runs where it has none."""

from __future__ import annotations

import pytest
from eventloom.plans import registry
from oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, data, name):
    assert_same(registry.QUERIES[name](spark, f"{data}/sf0.01"), registry.ORACLES[name], f"{data}/sf0.01")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, f"{data}/sf0.001").collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
