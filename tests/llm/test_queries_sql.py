"""Registered queries against their SQL text."""

import pytest
from oracle import compare, connect

from wearpath.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, name):
    problem, rows = compare(queries.BUILDERS[name](spark, sf_dir), connect(sf_dir), queries.SQL[name])
    assert problem is None, problem
    assert rows > 0
