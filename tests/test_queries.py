"""Every registered query against its SQL text, at the scale in TEST_SF_DIR."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from wearpath.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.BUILDERS))
def test_query(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        df.count()
        return
    problem, _ = compare(df, con, sql)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
