"""Session returns, bars without sorting, sheets by layout, page files, dated exports, repeated reports."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickersift.functions.charset import encode_text
from tickersift.functions.dates import week_start
from tickersift.operators.bars import bars_from_trades, resample
from tickersift.operators.calendar import sessions_near, trading_calendar
from tickersift.operators.panel import listed_returns, neighbour_returns
from tickersift.plans.fundamentals import latest_reports
from tickersift.registry import inputs
from tickersift.sinks.tables import export_day, write_page_files
from tickersift.sources.ledgers import read_sheet_folder
from tickersift.sources.pages import packed_page_files

MONDAY = date(2020, 1, 6)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def gapped(spark):
    """Symbol a trades on all of 6 sessions, b misses session 2, c has session 0 and 4 only, z has one bar."""
    traded = {"a": range(6), "b": (0, 1, 3, 4, 5), "c": (0, 4), "z": (5,)}
    rows = [(s, MONDAY + timedelta(days=k), float(10 * k + ord(s))) for s, days in traded.items() for k in days]
    return spark.createDataFrame(rows, "symbol string, bar_date date, pct_chg double")


def test_neighbours_are_sessions_of_the_market(gapped):
    rows = neighbour_returns(gapped, trading_calendar(gapped)).collect()
    found = {(r["symbol"], r["sess"]): (r["pct_b1"], r["pct_b2"], r["pct_n1"]) for r in rows}
    value = lambda s, k: float(10 * k + ord(s)) if (s, k) in found else None
    assert found == {(s, k): (value(s, k - 1), value(s, k - 2), value(s, k + 1)) for s, k in found}
    assert found["b", 3] == (None, 108.0, 138.0)  # no session before, but the one before that


def test_neighbours_share_one_shuffle(gapped):
    plan = neighbour_returns(gapped, trading_calendar(gapped))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(symbol") == 1


def test_every_listed_instrument_has_a_row(spark, gapped):
    master = spark.createDataFrame([(s,) for s in "abcxz"], "symbol string")
    calendar = trading_calendar(gapped)
    day = MONDAY + timedelta(days=3)
    rows = {r["symbol"]: r for r in listed_returns(master, gapped, calendar, day, ["pct_chg"]).collect()}
    assert {s: (r["pct_chg"], r["pct_b1"], r["pct_b2"], r["pct_n1"]) for s, r in rows.items()} == {
        "a": (127.0, 117.0, 107.0, 137.0),
        "b": (128.0, None, 108.0, 138.0),
        "c": (None, None, None, 139.0),
        "x": (None,) * 4,
        "z": (None,) * 4,
    }
    assert {r["bar_date"] for r in rows.values()} == {day}
    first = listed_returns(master, gapped, calendar, MONDAY, ["pct_chg"]).where("symbol = 'a'").first()
    assert (first["pct_b1"], first["pct_n1"]) == (None, 107.0)
    assert sessions_near(calendar, MONDAY, [-1, 2]) == {0: MONDAY, 2: MONDAY + timedelta(days=2)}
    with pytest.raises(ValueError, match="no session"):
        sessions_near(calendar, date(1999, 1, 1), [1])


def test_prices_keep_their_own_scale(spark):
    at = datetime(2020, 1, 6, 10)
    rows = [("a", at, 1, Decimal("1.234"), Decimal("0.5")), ("a", at, 2, Decimal("1.235"), Decimal("0.25"))]
    exact = spark.createDataFrame(rows, "symbol string, ts timestamp, seq int, price decimal(12,3), qty decimal(9,2)")
    loose = exact.withColumns({"price": F.col("price").cast("double"), "qty": F.col("qty").cast("double")})
    for trades, kind, hashed in ((exact, "decimal(12,3)", True), (exact, "decimal(12,3)", False), (loose, "decimal(18,4)", True), (loose, "decimal(18,4)", False)):
        bars = bars_from_trades(trades, week_start(F.col("ts")), ("ts", "seq"), hashed)
        assert dict(bars.dtypes)["close"] == kind
        bar = resample(bars, "week").first()
        assert (bar["open"], bar["close"], bar["high"], bar["low"], bar["vol"]) == tuple(map(Decimal, ("1.234", "1.235", "1.235", "1.234", "0.75")))


def test_trades_without_symbol_or_time_are_in_no_bar(spark):
    at = datetime(2020, 1, 6, 10)
    rows = [("a", at, 1, 2.0, 1.0), (None, at, 1, 3.0, 1.0), ("a", None, 1, 9.0, 1.0), ("b", at, None, None, None)]
    trades = spark.createDataFrame(rows, "symbol string, ts timestamp, seq int, price double, qty double")
    for hashed in (True, False):
        bars = {r["symbol"]: r for r in bars_from_trades(trades, week_start(F.col("ts")), ("ts", "seq"), hashed).collect()}
        assert set(bars) == {"a", "b"} and bars["a"]["high"] == 2 and bars["b"]["close"] is None


def test_hashed_bars_equal_sorted_ones(spark):
    rows = [(f"s{i % 3}", datetime(2020, 1, 1 + i % 9, 9 + i % 2), i % 4, float(i * 7 % 13), float(i % 5)) for i in range(600)]
    trades = spark.createDataFrame(rows, "symbol string, ts timestamp, seq int, price double, qty double")
    for session in (week_start(F.col("ts")), F.col("ts").cast("date")):
        hashed, sorted_ = (sorted(bars_from_trades(trades, session, ("ts", "seq"), h).collect()) for h in (True, False))
        assert hashed == sorted_ and len(hashed) > 5


def test_trades_are_not_sorted(spark):
    """From the first exchange of weekly bars down to the scan, trades are hashed."""
    bars = resample(inputs.daily_bars(spark, SMALL), "week")
    bars.collect()
    final = bars._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = final.splitlines()
    at = next(i for i, line in enumerate(lines) if "partial_min(ts" in line)
    scan = next(i for i in range(at, len(lines)) if "Scan parquet" in lines[i])
    assert "HashAggregate" in lines[at] and not any("SortAggregate" in x or "Sort [" in x for x in lines[at:scan])
    assert "Exchange" not in "".join(lines[at:scan])


def test_sheets_of_a_layout_are_read_together(spark, tmp_path):
    sheets = {
        "1992.csv": "成交日期,发生金额,证券名称\n92/01/02,5.00,\"A, B\"\n",
        "1993.csv": "成交日期,发生金额,证券名称\n93/01/02,6.00,C\n93/01/03,,D\n",
        "1994.csv": "证券名称,手续费,成交日期\nE,0.1,94/01/02\n",
        "1995.csv": "成交日期,发生金额,证券名称\n",
        "empty.csv": "",
    }
    for name, text in sheets.items():
        (tmp_path / name).write_text(text, encoding="gbk")
    found = read_sheet_folder(spark, str(tmp_path), "GBK")
    rows = {(r["sheet"], r["trade_date"], r["security"], r["amount"], r["fee"]) for r in found.collect()}
    assert rows == {
        ("1992", "92/01/02", "A, B", "5.00", None),
        ("1993", "93/01/02", "C", "6.00", None),
        ("1993", "93/01/03", "D", None, None),
        ("1994", "94/01/02", "E", None, "0.1"),
    }
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no sheet"):
        read_sheet_folder(spark, str(tmp_path / "none"))


def test_page_files_keep_every_byte(spark, tmp_path):
    texts = ["<p>中文</p>, \"quoted\"", "  blanks  ", "x", "a,b\\c"]
    raw = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").select("page_id", encode_text(spark, F.col("html")).alias("content"))
    raw = raw.unionByName(spark.createDataFrame([(9, bytearray(b"ok\xff"))], "page_id long, content binary"))
    write_page_files(raw, str(tmp_path / "pages"))
    read = packed_page_files(spark, str(tmp_path / "pages"), glob="*.csv")
    found = {int(r["url"].split("page_id=")[1].split("/")[0]): r["html"] for r in read.collect()}
    assert found == {**dict(enumerate(texts)), 9: "ok�"}
    assert read.rdd.getNumPartitions() < len(found)
    with pytest.raises(Exception, match="line breaks"):
        write_page_files(spark.createDataFrame([(1, bytearray(b"a\nb"))], "page_id long, content binary"), str(tmp_path / "broken"))


def test_a_day_can_be_exported_again(spark, tmp_path):
    path, days = str(tmp_path / "reports"), [MONDAY, MONDAY + timedelta(days=1)]
    frame = lambda *rows: spark.createDataFrame(list(rows), "symbol string, value int")
    export_day(frame(("a", 1), ("b", 2)), path, days[0])
    export_day(frame(("a", 3)), path, days[1])
    export_day(frame(("c", 4)), path, days[0])
    export_day(frame().where("false"), path, days[1])
    rows = {(r["report_date"], r["symbol"], r["value"]) for r in spark.read.parquet(path).collect()}
    assert rows == {(days[0], "c", 4), (days[1], "a", 3)}


def test_repeated_reports_count_once(spark):
    rows = [("a", 1, 1.0, None, 1), ("a", 1, 2.0, "x", 2), ("a", 1, 2.0, "x", 2), ("a", 2, 5.0, "y", 1), ("b", 1, None, "z", 3), ("b", 1, 9.0, "w", 2), ("b", 2, 1.0, "n", None)]
    downloads = spark.createDataFrame(rows, "symbol string, report_end int, eps double, note string, pass int")
    found = latest_reports(downloads, "pass")
    assert found.columns == ["symbol", "report_end", "eps", "note"]
    assert {tuple(r) for r in found.collect()} == {("a", 1, 2.0, "x"), ("a", 2, 5.0, "y"), ("b", 1, None, "z")}
    numbers = latest_reports(downloads.drop("note"), "pass")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in numbers and "SortAggregate" not in numbers
