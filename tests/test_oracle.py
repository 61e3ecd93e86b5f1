"""Every SQL-checked query against its DuckDB oracle on the smallest scale factor."""

import pytest

from conftest import SF_SMALL


def _sql_keys():
    from baleprice.plans.catalog import REGISTRY
    return [k for k, q in REGISTRY.items() if q.sql]


@pytest.fixture(scope="module")
def results(spark):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from compare import compare
    return compare(spark, SF_SMALL, _sql_keys())


@pytest.mark.parametrize("key", _sql_keys())
def test_matches_oracle(results, key):
    assert results[key]["ok"], results[key]


def test_registry_contract():
    from __spark_entry__ import oracle_sql, queries
    q, s = queries(), oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60
