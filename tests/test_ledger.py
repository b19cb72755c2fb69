from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickersift.operators.ledger import (
    cash_flow,
    clean_ledger,
    cleared_profit,
    profit_list,
    ranked_profit,
    security_totals,
)
from tickersift.sources.ledgers import read_sheets, read_uniform_sheets
from tickersift.sources.schemas import LEDGER_COLUMNS, LEDGER_HEADER, conform

RAW = "security string, business string, amount string, fee string, trade_date string"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("", "银行转存", "1000", "0", "19/8/8"),
        ("", "银行转取", "-300.50", "0", "19/8/9"),
        ("科蓝软件", "证券买入", "-200.005", "1.5", "69/1/2"),
        ("科蓝软件", "证券卖出", "250", "x", "bad"),
        ("平安银行", "证券卖出", "--", "2", "19/8/8"),
        ("平安银行", "证券卖出", "80", None, "19/8/8"),
        (None, "利息", "5", "0", "19/8/8"),
        ("新股", "申购配号", "7", "9", "19/8/8"),
        ("天天", "天添利申购", "7", "9", "19/8/8"),
        ("无", None, "7", "9", "19/8/8"),
    ]
    return spark.createDataFrame(rows, RAW)


def test_clean_conforms_and_filters(raw):
    clean = clean_ledger(raw)
    assert tuple(clean.columns) == LEDGER_COLUMNS and len(LEDGER_COLUMNS) == 16
    assert clean.count() == 7  # excluded business types and the NULL one are gone
    assert clean.where("currency is null").count() == 7
    assert clean.where("trade_date is null").count() == 1
    assert clean.where("trade_date = date'1969-01-02'").count() == 1


def test_profit_list_drops_the_first_name(raw):
    rows = ranked_profit(profit_list(clean_ledger(raw))).orderBy("rank").collect()
    assert [(r["rank"], r.security, r.profit) for r in rows] == [
        (0, "平安银行", Decimal("80.00")),
        (1, "科蓝软件", Decimal("50.00")),
    ]


def test_blank_mode_keeps_the_first_real_name(spark):
    clean = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "security string, amount double")
    assert [r.security for r in profit_list(clean).collect()] == ["B"]
    assert sorted(r.security for r in profit_list(clean, drop="blank").collect()) == ["A", "B"]


def test_missing_security_is_no_group(raw):
    assert None not in [r.security for r in security_totals(clean_ledger(raw)).collect()]


def test_cash_flow(raw):
    row = cash_flow(clean_ledger(raw)).first()
    assert (row.deposits, row.withdrawals, row.net_inflow) == (1000, Decimal("-300.5"), Decimal("699.5"))
    assert (row.fees, row.stamp_duties, row.row_count, row.column_count) == (Decimal("3.5"), 0, 7, 16)


def test_sums_over_nothing_are_zero(spark):
    bad = spark.createDataFrame([("a", "银行转存", "--", "n/a", "x")], RAW)
    row = cash_flow(clean_ledger(bad)).first()
    assert (row.deposits, row.withdrawals, row.net_inflow, row.fees) == (0, 0, 0, 0)
    assert security_totals(clean_ledger(bad)).first().profit == 0
    assert cleared_profit(profit_list(clean_ledger(bad))).first().cleared_profit == 0


def test_cleared_profit_leaves_out_open_positions(raw):
    assert cleared_profit(profit_list(clean_ledger(raw))).first().cleared_profit == Decimal("80.00")


def test_rounding_is_exact(spark):
    rows = [("z", "x", "0.105", "0", ""), ("a", "x", "1", "0", "")]
    totals = {r.security: r.profit for r in security_totals(clean_ledger(spark.createDataFrame(rows, RAW))).collect()}
    assert totals["z"] == Decimal("0.11")


def test_sheets_of_different_layouts(spark, tmp_path):
    header = {v: k for k, v in LEDGER_HEADER.items()}
    (tmp_path / "2017.csv").write_bytes(
        f'{header["security"]},{header["business"]},{header["amount"]}\n平安银行,"证券,卖出",10\n'.encode("gbk")
    )
    (tmp_path / "2018.csv").write_bytes(
        f'{header["amount"]},备注,{header["business"]},{header["fee"]}\n20,"说 ""好""",利息,\n'.encode("gbk")
    )
    sheets = {n: str(tmp_path / f"{n}.csv") for n in ("2017", "2018")}
    rows = {r.sheet: r for r in read_sheets(spark, sheets, "GBK").collect()}
    assert (rows["2017"].security, rows["2017"].business, rows["2017"].fee) == ("平安银行", "证券,卖出", None)
    assert (rows["2018"].security, rows["2018"].amount, rows["2018"].fee) == (None, "20", None)
    assert rows["2018"]["备注"] == '说 "好"'


def test_uniform_sheets_keep_their_file_name(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.csv").write_text(f"证券名称,发生金额\n{n},1\n", encoding="utf-8")
    rows = read_uniform_sheets(spark, str(tmp_path), "`证券名称` string, `发生金额` string")
    assert sorted((r.sheet, r.security, r.amount) for r in rows.collect()) == [("a.csv", "a", "1"), ("b.csv", "b", "1")]


def test_conform_fills_and_orders(spark):
    df = conform(spark.createDataFrame([(1, "x")], "b int, extra string"), ("a", "b"))
    assert df.columns == ["a", "b"] and df.first().a is None
    assert df.select(F.col("a")).schema["a"].dataType.simpleString() == "string"
