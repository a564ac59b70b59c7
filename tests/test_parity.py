"""Every query with a SQL check gives the same rows as DuckDB."""

import pytest

import parity
from strandloom.plans.catalogue import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(name, spark, folder, duck):
    assert parity.difference(QUERIES[name](spark, folder), duck, CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(name, spark, folder):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
