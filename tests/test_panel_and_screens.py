import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickersift.operators.bars import moving_averages
from tickersift.operators.calendar import session_offsets, sessions_around, trading_calendar
from tickersift.operators.panel import session_panel
from tickersift.plans import screens as s
from tickersift.plans.daily import daily_screen, daily_screens
from tickersift.functions.numeric import never_rising

MONDAY = date(2020, 1, 6)


def day(n):
    return MONDAY + timedelta(days=n)


def test_calendar_is_dense_over_all_symbols(make_bars):
    rows = trading_calendar(make_bars([("a", 0, 1), ("b", 3, 1), ("a", 7, 1), ("b", 7, 1)])).orderBy("sess").collect()
    assert [(r.sess, r.bar_date) for r in rows] == [(0, day(0)), (1, day(3)), (2, day(7))]


def test_offsets_at_the_ends(make_bars):
    rows = session_offsets(trading_calendar(make_bars([("a", i, 1) for i in range(3)]))).orderBy("sess").collect()
    assert (rows[0].t_b1, rows[0].t_n1, rows[2].t_b2, rows[2].t_n1) == (None, "20200107", "20200106", None)


def test_sessions_around(make_bars):
    calendar = trading_calendar(make_bars([("a", i, 1) for i in (0, 1, 2, 5, 6, 7, 8)]))
    assert sessions_around(calendar, day(6), 5) == (day(0), day(6), day(7))
    assert sessions_around(calendar, day(9), 2) == (day(6), day(8), day(8))
    with pytest.raises(ValueError):
        sessions_around(calendar, day(-1), 5)


def test_panel_goes_by_market_sessions(make_bars):
    whole = [("a", i, 10 + i, {"tor": float(i)}) for i in range(8)]
    gap = [("b", i, 1) for i in (0, 1, 2, 4, 5, 6, 7)]  # misses session 3
    panel = session_panel(make_bars(whole + gap), trading_calendar(make_bars(whole)))
    rows = sorted(panel.collect(), key=lambda r: (r.symbol, r.sess))
    assert [(r.symbol, r.sess) for r in rows] == [("a", 5), ("a", 6), ("a", 7)]
    assert [rows[0][f"tor_b{k}"] for k in range(1, 6)] == [4.0, 3.0, 2.0, 1.0, 0.0]


def test_next_return_needs_the_next_session(make_bars):
    rows = [("a", i, 1, {"pct_chg": float(i)}) for i in (0, 1, 2, 3, 4, 5, 6, 8)] + [("z", 7, 1), ("z", 9, 1)]
    bars = make_bars(rows)
    panel = {r.sess: r for r in session_panel(bars, trading_calendar(bars)).collect()}
    assert panel[5].pct_n1 == 6.0 and panel[5].pct_b1 == 4.0 and panel[5].pct_b2 == 3.0
    assert panel[6].pct_n1 is None  # session 7 was missed, although a later bar exists


def test_panel_does_not_depend_on_partitioning(make_bars):
    rows = [(f"s{k}", i, (i * 5 + k) % 7 + 1) for k in range(5) for i in range(12) if (i + k) % 9]
    bars = make_bars(rows)
    calendar = trading_calendar(bars)
    results = [sorted(map(str, session_panel(bars.repartition(n, "close"), calendar).collect())) for n in (1, 6)]
    assert results[0] == results[1]


@pytest.fixture(scope="module")
def market(make_bars):
    """Eight symbols over 75 sessions with metrics, names and areas."""
    pick = random.Random(7)
    rows = []
    for k in range(8):
        for i in range(75):
            close = pick.randint(20, 40)
            values = {
                "open": close - pick.randint(0, 3),
                "low": pick.randint(5, 25),
                "high": pick.randint(25, 50),
                "tor": float(pick.randint(3, 15)),
                "pct_chg": float(pick.randint(-2, 5)),
            }
            rows.append((f"s{k}", i, close, values))
    bars = make_bars(rows)
    return bars.withColumns({"pe": F.lit(30.0), "pe_ttm": F.lit(30.0)})


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame([(f"s{k}", f"n{k}", "上海" if k % 2 else None, "x") for k in range(8)],
                                 "symbol string, name string, area string, industry string")


@pytest.mark.parametrize("name", sorted(s.DAILY))
def test_daily_screen_equals_the_panel_screen_on_that_day(market, master, name):
    screen, calendar = s.DAILY[name], trading_calendar(market)
    panel = session_panel(moving_averages(market, screen.averages or (5,)), calendar).join(master, "symbol")
    loose = {
        "steady_turnover": s.SteadyTurnover(0, 99),
        "valley_turnover": s.ValleyTurnover(0, 0),
        "v_shape": s.VShape(-9, 9, 0),
        "rising_lows": s.RisingLows(9),
        "doji": s.Doji(1.0, -9, 9, -9, 9),
        "turnover_surge": s.TurnoverSurge(1, 1.1),
        "cross_all_averages": s.CrossAllAverages(1, 99, 1, 99, 1, 1),
    }[name]
    whole = s.report(screen.survivors(panel, loose))
    for n in (62, 65, 69):
        daily = daily_screen(name, market, calendar, master, day(n), day(0), loose).collect()
        assert sorted(map(str, daily)) == sorted(map(str, whole.where(F.col("bar_date") == F.lit(day(n))).collect()))
        known = [r.pct_n1 for r in daily if r.pct_n1 is not None]
        assert known == sorted(known, reverse=True)
    assert whole.count() > 0


def test_daily_screens_by_name(market, master):
    found = daily_screens(market, trading_calendar(market), master, day(65), day(0), {"doji": None, "v_shape": None})
    assert list(found) == ["doji", "v_shape"] and all(list(df.columns) == list(s.REPORT) for df in found.values())


def test_fixed_bounds():
    assert s.SteadyTurnover() == s.SteadyTurnover(9, 30, 10, 150, 18, 60)
    assert s.Doji().areas == ("江苏", "浙江", "上海", "广东", "深圳", "北京")
    assert (s.TurnoverSurge().close_min, s.TurnoverSurge().factor) == (10, 3)


def test_area_null_fails_doji(market, master):
    panel = session_panel(market, trading_calendar(market)).join(master, "symbol")
    rows = s.DAILY["doji"].rows(panel, s.Doji(1.0, -9, 9, -9, 9))
    assert {r.symbol for r in rows.select("symbol").distinct().collect()} <= {"s1", "s3", "s5", "s7"}


def test_look_ahead_is_optional(market, master):
    panel = session_panel(market, trading_calendar(market)).join(master, "symbol")
    rows = s.DAILY["doji"].rows(panel, s.Doji(1.0, -9, 9, look_ahead=False))
    assert rows.where("pct_n1 is null").count() > 0


def test_equal_close_and_average(make_bars):
    flat = [("a", i, 12) for i in range(70)]
    bars = make_bars(flat).withColumns({"pe": F.lit(30.0), "pe_ttm": F.lit(30.0)})
    panel = session_panel(moving_averages(bars), trading_calendar(bars))
    last = panel.where(F.col("sess") == 69)
    assert last.where(s.at_or_above(5) & s.at_or_above(60)).count() == 1
    assert s.DAILY["cross_all_averages"].survivors(last, s.CrossAllAverages(1, 99, 1, 99, 1, 1)).count() == 0


def test_surge_from_zero(make_bars):
    tor = {"a": (0.0, 5.0), "b": (0.0, 0.0), "c": (2.0, 6.0)}
    rows = [(n, i, 50, {"tor": t[1] if i == 6 else t[0]}) for n, t in tor.items() for i in range(7)]
    bars = make_bars(rows)
    panel = session_panel(moving_averages(bars, (5,)), trading_calendar(bars)).where(F.col("sess") == 6)
    assert {r.symbol for r in s.DAILY["turnover_surge"].survivors(panel).collect()} == {"a", "c"}


def test_weekly_rising_per_symbol(make_bars):
    bars = make_bars(
        [("a", 0, 1), ("a", 7, 2), ("a", 14, 2), ("b", 0, 3), ("b", 7, 2), ("b", 14, 4), ("c", 0, 1), ("c", 14, 2)]
    )
    assert [(r.symbol, r.close) for r in s.weekly_rising(bars).collect()] == [("a", Decimal("2.00"))]
    assert [(r.symbol, r.close) for r in s.weekly_rising_now(bars).collect()] == [("a", Decimal("2.00"))]


def test_monotone_test_of_one_value(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert df.where(never_rising(F.col("x"), F.col("x"))).count() == 1
