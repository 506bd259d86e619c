"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import pytest

from conftest import SF_SMALL
from herbaria.plans.catalog import QUERIES

import oracle_compare


@pytest.fixture(scope="module")
def con():
    return oracle_compare.duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = oracle_compare.compare(spark, name, SF_SMALL, con)
    assert ok, msg


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
