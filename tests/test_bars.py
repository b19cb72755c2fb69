from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickersift.functions.dates import week_start
from tickersift.operators.bars import (
    bars_from_trades,
    forward_adjusted,
    latest_averages,
    latest_rows,
    moving_averages,
    only_survivors,
    percent_change,
    resample,
)

TRADES = "symbol string, ts timestamp, seq int, price double, qty double"


def test_first_and_last_trade_with_ties(spark):
    t = datetime(2020, 1, 6, 10)
    rows = [("a", t, 2, 5.0, 1.0), ("a", t, 1, 7.0, 2.0), ("a", t, 2, 4.0, 3.0), ("a", t, 2, 6.0, 1.0)]
    bar = bars_from_trades(spark.createDataFrame(rows, TRADES), week_start(F.col("ts")), ("ts", "seq")).first()
    assert (bar.open, bar.close, bar.high, bar.low, bar.vol) == tuple(map(Decimal, ("7.00", "6.00", "7.00", "4.00", "7.00")))
    assert bar.bar_date == date(2020, 1, 6)


def test_bars_do_not_depend_on_partitioning(spark):
    rows = [(f"s{i % 3}", datetime(2020, 1, 1 + i % 9, i % 24), i, float(i * 7 % 13), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, TRADES)
    results = [
        sorted(bars_from_trades(df.repartition(n, *by), week_start(F.col("ts")), ("ts", "seq")).collect())
        for n, by in ((1, ()), (7, ("seq",)), (5, ("price",)))
    ]
    assert results[0] == results[1] == results[2]


def test_weekly_from_daily_equals_weekly_from_trades(spark):
    rows = [("a", datetime(2020, 1, d, h), d * 100 + h, float(d * h % 17), 1.0) for d in range(1, 29) for h in (9, 12, 15)]
    df = spark.createDataFrame(rows, TRADES)
    direct = bars_from_trades(df, week_start(F.col("ts")), ("ts", "seq"))
    daily = bars_from_trades(df, F.col("ts").cast("date"), ("ts", "seq"))
    columns = ["symbol", "bar_date", "open", "high", "low", "close", "vol"]
    assert sorted(direct.select(columns).collect()) == sorted(resample(daily, "week").select(columns).collect())


def test_average_needs_n_bars(make_bars):
    rows = moving_averages(make_bars([("a", i, i + 1) for i in range(7)]), (5,)).orderBy("bar_date").collect()
    assert [r.ma5 for r in rows] == [None] * 4 + [3.0, 4.0, 5.0]
    assert [r.ma5_sum for r in rows][4:] == [15, 20, 25]


def test_average_with_a_missing_close_is_unknown(make_bars):
    closes = [1, 2, None, 4, 5, 6, 7, 8, 9]
    bars = make_bars([("a", i, c) for i, c in enumerate(closes)])
    rows = moving_averages(bars, (3,)).orderBy("bar_date").collect()
    assert [r.ma3 for r in rows] == [None, None, None, None, None, 5.0, 6.0, 7.0, 8.0]


def test_averages_count_own_bars_not_sessions(make_bars):
    bars = make_bars([("a", s, s) for s in (0, 3, 10, 11)])
    assert [r.ma3 for r in moving_averages(bars, (3,)).orderBy("bar_date").collect()][2:] == [13 / 3, 8.0]


def test_latest_averages_equal_the_last_row(make_bars):
    rows = [(s, i, (i * 7 + k) % 11 + 1) for k, s in enumerate("abc") for i in range(4 + 30 * k)]
    bars = make_bars(rows).withColumn("adj_factor", (F.dayofmonth("bar_date") + 1).cast("decimal(18,6)"))
    lengths = (5, 20)
    columns = ["symbol", "bar_date", "close", "low", "scaled_close", "ma5", "ma20", "ma5_sum", "ma20_sum"]
    whole = latest_rows(moving_averages(bars, lengths)).select(columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, latest_averages(bars, lengths).select(columns).collect()))


def test_adjusted_average_equals_average_of_adjusted_prices(make_bars):
    bars = make_bars([("a", i, 10 + i) for i in range(8)])
    bars = bars.withColumn("adj_factor", F.when(F.dayofmonth("bar_date") > 9, 2).otherwise(1).cast("decimal(18,6)"))
    newest = latest_averages(bars, (5,)).first()
    adjusted = sorted(forward_adjusted(bars).collect(), key=lambda r: r.bar_date)
    assert adjusted[-1].close == 17.0 and adjusted[0].close == 5.0
    assert newest.ma5 == pytest.approx(sum(r.close for r in adjusted[-5:]) / 5)


def test_percent_change_uses_own_last_bar(make_bars):
    rows = percent_change(make_bars([("a", 0, 10), ("a", 5, 12), ("a", 6, 0), ("a", 7, 3)])).orderBy("bar_date").collect()
    assert [r.pct_chg for r in rows] == [None, 20.0, -100.0, None]


def test_latest_rows_of_a_short_history(make_bars):
    rows = latest_rows(make_bars([("a", 0, 1), ("b", 0, 1), ("b", 1, 2), ("b", 2, 3), ("b", 3, 4)]), 3).collect()
    assert sorted((r.symbol, r.age, int(r.close)) for r in rows) == [("a", 1, 1), ("b", 1, 4), ("b", 2, 3), ("b", 3, 2)]


def test_only_survivors(make_bars, spark):
    bars = make_bars([("a", 0, 1), ("b", 0, 1), ("b", 1, 2)])
    found = spark.createDataFrame([("b",), ("b",), ("c",)], "symbol string")
    assert sorted(r.close for r in only_survivors(bars, found).collect()) == [1, 2]
