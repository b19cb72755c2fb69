from datetime import date

import pytest

from tickersift.plans.fundamentals import (
    HighTransfer,
    SmallCap,
    forecast_enrich,
    fundamentals_join,
    high_transfer,
    rescaled,
    small_cap,
    snapshot_enrich,
)
from tickersift.sources.schemas import DAILY_METRIC
from tickersift.sources.market import between_dates, first_symbols, listed_instruments, read_table, snapshot

QUOTE = (
    "symbol string, close double, float_share double, total_share double, circ_mv double, total_mv double, "
    "pe double, bar_date date"
)


@pytest.fixture(scope="module")
def quotes(spark):
    d = date(2019, 8, 13)
    return spark.createDataFrame(
        [
            ("fits", 25.0, 1e4, 3e4, 5e5, 1e6, 60.0, d),
            ("dear", 26.0, 1e4, 3e4, 5e5, 1e6 + 1, 10.0, d),
            ("none", None, None, None, None, None, None, d),
            ("tiny", 5.0, 1e4, 3e4, 5e4, 1e5, 0.0, d),
            ("mini", 5.0, 1e4, 3e4, 5e4, 2e5, 1.0, d),
        ],
        QUOTE,
    )


@pytest.fixture(scope="module")
def indicators(spark):
    rows = [("fits", date(2019, 3, 31), 2.0, 0.5), ("fits", date(2019, 6, 30), 3.0, 0.6), ("fits", date(2018, 12, 31), 1.9, 9.0),
            ("dear", date(2019, 6, 30), 5.0, 5.0), ("none", date(2019, 6, 30), 5.0, 5.0), ("lost", date(2019, 6, 30), 5.0, 5.0)]
    return spark.createDataFrame(rows, "symbol string, report_end date, capital_rese_ps double, eps double")


def test_high_transfer_with_fixed_bounds(quotes, indicators):
    assert HighTransfer() == HighTransfer(25, 2, 0.5, 3, 1, 100)
    rows = high_transfer(quotes, indicators).collect()
    assert sorted((r.symbol, r.report_end.month) for r in rows) == [("fits", 3), ("fits", 6)]
    assert {(r.total_mv, r.float_share, r.circ_mv) for r in rows} == {(100.0, 1.0, 50.0)}


def test_rescaling_is_pure(quotes):
    before = sorted(map(str, quotes.collect()))
    rescaled(quotes).collect()
    assert sorted(map(str, quotes.collect())) == before


def test_small_cap_bounds_and_order(quotes):
    assert SmallCap() == SmallCap(3, 20, 25, 0, 60)
    rows = small_cap(quotes).collect()
    assert [(r.symbol, r.total_mv) for r in rows] == [("mini", 20.0)]  # pe must exceed 0
    assert [r.symbol for r in small_cap(quotes, SmallCap(3, 200, 25)).collect()] == ["fits", "mini"]


def test_left_joins_keep_unmatched_rows(spark, quotes, indicators):
    master = spark.createDataFrame([("fits", "F"), ("new", "N")], "symbol string, name string")
    prices = quotes.select("symbol", "bar_date").where("symbol = 'none'").withColumnRenamed("symbol", "symbol")
    rows = {r.symbol: r for r in snapshot_enrich(master, quotes, prices).collect()}
    assert rows["new"].close is None and rows["fits"].close == 25.0
    joined = fundamentals_join(indicators, quotes)
    assert joined.count() == 6 and joined.where("symbol = 'lost' and close is null").count() == 1


def test_forecasts_fan_in_on_one_symbol(spark, quotes):
    rows = [("fits", date(2019, 8, 1 + i % 20), date(2019, 9, 30), "up", float(i), float(i + 1)) for i in range(50)]
    rows.append(("lost", date(2019, 8, 1), date(2019, 9, 30), "up", 1.0, 2.0))
    schema = "symbol string, ann_date date, end_date date, type string, p_change_min double, p_change_max double"
    out = forecast_enrich(spark.createDataFrame(rows, schema), quotes.select("symbol", "close")).collect()
    assert len(out) == 51 and sum(r.close == 25.0 for r in out) == 50


def test_scans(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [("b", "L", 1.0), ("a", "L", float("nan")), ("c", "D", 2.0)]
    spark.createDataFrame(rows, "symbol string, list_status string, pe double").write.parquet(path)
    table = read_table(spark, path)
    assert table.where("pe is null").count() == 1
    assert read_table(spark, path, ["pe"]).columns == ["pe"]
    typed = read_table(spark, path, schema=DAILY_METRIC)
    assert dict(typed.dtypes)["bar_date"] == "date" and typed.where("pe is null").count() == 1
    listed = listed_instruments(table, ("symbol", "pe"))
    assert sorted(r.symbol for r in listed.collect()) == ["a", "b"]
    assert [r.symbol for r in first_symbols(listed, 1).collect()] == ["a"]


def test_date_ranges_are_inclusive(quotes):
    assert between_dates(quotes, date(2019, 8, 13), date(2019, 8, 13)).count() == 5
    assert snapshot(quotes, date(2019, 8, 12)).count() == 0
