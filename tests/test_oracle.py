"""Every registered query against its SQL counterpart, and known row counts."""

import pytest

import __spark_entry__ as contract
from compare import compare, oracle_connection
from tickersift.registry.oracle import SQL
from tickersift.registry.queries import QUERIES

SMALL = "/root/testdata/sf0.001"

# The smallest tables have no symbol rising in its last weeks.
EMPTY_WHEN_TINY = {"screen_weekly_rising_now"}

COUNTS = {
    "session_panel": 975,
    "screen_steady_turnover": 114,
    "screen_valley_turnover": 7,
    "screen_v_shape": 3,
    "screen_rising_lows": 22,
    "screen_doji": 110,
    "screen_cross_all_ma": 104,
    "screen_turnover_surge": 78,
    "screen_weekly_rising": 120,
    "screen_small_cap": 3,
    "screen_high_transfer": 23,
    "forecast_enrich": 274,
    "page_links": 281,
    "page_link_follow": 258,
    "page_chapters": 80,
}


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    got, want, difference = compare(spark, oracle, SMALL, name)
    assert not difference
    assert got == want
    assert got > 0 or name in EMPTY_WHEN_TINY
    assert got == COUNTS.get(name, got)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == COUNTS["screen_cross_all_ma"]
