"""Bar tables kept between jobs."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickersift.functions.scratch import scratch_path
from tickersift.operators.bars import AVERAGES, moving_averages, percent_change
from tickersift.operators.calendar import trading_calendar
from tickersift.operators.panel import session_panel
from tickersift.operators.stored import append_averages, bars_by_symbol, start_averages, stored_averages
from tickersift.plans import screens as s
from tickersift.plans.daily import daily_screens
from tickersift.sources.market import between_dates

MONDAY = date(2020, 1, 6)
LOOSE = {
    "steady_turnover": s.SteadyTurnover(0, 99),
    "valley_turnover": s.ValleyTurnover(0, 0),
    "v_shape": s.VShape(-9, 9, 0),
    "rising_lows": s.RisingLows(9),
    "doji": s.Doji(1.0, -9, 9, -9, 9),
    "turnover_surge": s.TurnoverSurge(1, 1.1),
    "cross_all_averages": s.CrossAllAverages(1, 99, 1, 99, 1, 1),
}


def day(n):
    return MONDAY + timedelta(days=n)


@pytest.fixture(scope="module")
def market(make_bars):
    """Symbols with gaps, one that is new near the end, one that has left, and missing closes."""
    pick = random.Random(7)
    rows = []
    for k in range(9):
        for i in range(60 if k == 7 else 0, 40 if k == 8 else 80):
            if pick.random() < (0.1 if k < 3 else 0):
                continue
            close = None if k == 4 and pick.random() < 0.05 else pick.randint(10, 30)
            values = {"low": pick.randint(5, 25), "high": pick.randint(25, 50), "tor": float(pick.randint(3, 15)), "pct_chg": float(pick.randint(-2, 5))}
            rows.append((f"s{k}", i, close, values))
    factor = (F.lit(1) + F.pmod(F.xxhash64("symbol", F.month("bar_date")), F.lit(3))).cast("decimal(10,2)")
    return make_bars(rows).withColumns({"pe": F.lit(30.0), "pe_ttm": F.lit(30.0), "adj_factor": factor})


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame([(f"s{k}", f"n{k}", "上海", "x") for k in range(9)], "symbol string, name string, area string, industry string")


def sums(df):
    columns = ["symbol", "bar_date", "scaled_close", "scaled_low", *[f"ma{n}_sum" for n in AVERAGES]]
    return sorted(map(str, df.select(*columns).collect()))


def test_windows_over_stored_bars_need_no_shuffle(spark, market):
    stored = bars_by_symbol(market, scratch_path(spark, "by-symbol"), 4)
    panel = session_panel(moving_averages(percent_change(stored)), trading_calendar(stored))
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "hashpartitioning(symbol" not in plan
    plain = session_panel(moving_averages(percent_change(market)), trading_calendar(market))
    assert "hashpartitioning(symbol" in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, panel.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert stored.select(F.input_file_name()).distinct().count() <= 4


def test_all_screens_in_one_pass(market, master):
    panel = session_panel(moving_averages(market), trading_calendar(market)).join(master, "symbol")
    found = s.report(s.all_survivors(panel, LOOSE), "screen")
    for name, bounds in LOOSE.items():
        own = s.report(s.DAILY[name].survivors(panel, bounds))
        assert sorted(map(str, found.where(F.col("screen") == name).drop("screen").collect())) == sorted(map(str, own.collect()))
    assert found.select("screen").distinct().count() >= 5


@pytest.mark.parametrize("factor", [True, False])
def test_appended_sums_are_those_of_the_whole_history(spark, market, factor):
    bars = market if factor else market.drop("adj_factor")
    path = scratch_path(spark, "averages")
    start_averages(bars, path, day(50))
    for n in (57, 58, 79):
        append_averages(bars, path, day(n))
    want = sums(moving_averages(bars))
    assert sums(stored_averages(spark, path)) == want
    append_averages(bars, path, day(58))  # again
    assert sums(stored_averages(spark, path)) == want


def test_append_reads_no_history(spark, market):
    path = scratch_path(spark, "averages")
    start_averages(market, path, day(70))
    append_averages(market.where(F.col("bar_date") > F.lit(day(70))), path, day(79))
    assert sums(stored_averages(spark, path)) == sums(moving_averages(market))


def test_append_corrects_its_own_dates_only(spark, market):
    path = scratch_path(spark, "averages")
    start_averages(market, path, day(70))
    corrected = market.withColumn("close", F.when(F.col("bar_date") <= F.lit(day(70)), F.col("close")).otherwise(F.col("close") + 1).cast("decimal(18,2)"))
    append_averages(market, path, day(79))
    append_averages(corrected, path, day(79))
    assert sums(stored_averages(spark, path)) == sums(moving_averages(corrected))


def test_nothing_stored_before_the_day(spark, market):
    path = scratch_path(spark, "averages")
    start_averages(market, path, day(50))
    with pytest.raises(ValueError, match="no averages"):
        append_averages(market, path, day(50))


def test_no_bars_at_all(spark, market):
    path = scratch_path(spark, "averages")
    start_averages(market, path, day(50))
    append_averages(market.where("false"), path, day(60))
    append_averages(market, path, day(79))  # goes on from the empty run
    assert stored_averages(spark, path).where(F.col("bar_date").between(day(51), day(60))).count() == 0


def test_daily_screens_from_stored_averages_read_seven_sessions(spark, market, master):
    path = scratch_path(spark, "averages")
    start_averages(market, path, day(60))
    append_averages(market, path, day(70))
    calendar = trading_calendar(market)
    want = daily_screens(market, calendar, master, day(65), day(0), LOOSE)
    week = between_dates(market, day(60), day(66))  # all that is left of the bars
    found = daily_screens(week, calendar, master, day(65), day(0), LOOSE, stored_averages(spark, path))
    for name in LOOSE:
        assert found[name].collect() == want[name].collect()
    assert sum(df.count() for df in found.values()) > 0
