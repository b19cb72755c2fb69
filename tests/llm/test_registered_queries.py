"""Registered corpus queries against their SQL."""

import pytest

import compare
from tickersift.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, want, difference = compare.compare(spark, compare.oracle_connection(SMALL), SMALL, name)
    assert not difference and got == want > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
