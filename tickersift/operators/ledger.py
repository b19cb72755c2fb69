"""Broker-ledger reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersift.functions.dates import lenient_short_date
from tickersift.functions.numeric import lenient_decimal
from tickersift.functions.scratch import staged
from tickersift.functions.text import contains_none
from tickersift.operators.ranking import ranked
from tickersift.sources.schemas import LEDGER_COLUMNS, conform

# Business types and names that the reports look for.
NOT_TRADES = ("申购配号", "保证金", "天添利")
DEPOSIT = "银行转存"
WITHDRAWAL = "银行转取"
OPEN_POSITIONS = ("科蓝软件", "神州数码", "隆基股份")

NUMBERS = ("quantity", "amount", "fee", "stamp_duty", "transfer_fee")


def clean_ledger(raw: DataFrame, excluded: Sequence[str] = NOT_TRADES) -> DataFrame:
    """The fixed ledger columns, typed, without the excluded business types.

    Text that is no number or no date becomes NULL. A row without a business type is
    dropped, as a negated match on NULL is unknown.
    """
    rows = conform(raw, LEDGER_COLUMNS).where(contains_none(F.col("business"), excluded))
    return rows.withColumns(
        {"trade_date": lenient_short_date(F.col("trade_date")), **{c: lenient_decimal(F.col(c)) for c in NUMBERS}}
    )


def security_totals(clean: DataFrame) -> DataFrame:
    """Sum of amounts per security in whole cents; rows without a security are left out."""
    return (
        clean.where(F.col("security").isNotNull())
        .groupBy("security")
        .agg(F.round(F.coalesce(F.sum("amount"), F.lit(0)), 2).alias("profit"))
    )


def profit_list(clean: DataFrame, drop: str = "first") -> DataFrame:
    """Profit per security without the cash rows.

    Cash movements carry a blank name, which sorts first. ``drop='first'`` removes the
    smallest name whatever it is; ``drop='blank'`` removes only a blank one. The totals
    are written out, so that looking for the smallest name does not read the ledger again.
    """
    totals = security_totals(clean)
    if drop == "blank":
        return totals.where(F.trim("security") != "")
    totals = staged(totals, "profit")
    first = totals.agg(F.min("security")).scalar()
    return totals.where(F.col("security") != first)


def ranked_profit(profits: DataFrame) -> DataFrame:
    """Profit list from the largest gain to the largest loss, ``rank`` from 0."""
    rows = ranked(profits, [F.desc("profit"), F.asc("security")])
    return rows.withColumn("rank", F.col("rank") - 1)


def cash_flow(clean: DataFrame, deposit: str = DEPOSIT, withdrawal: str = WITHDRAWAL) -> DataFrame:
    """Deposits, withdrawals, their net, fee totals and the table's size, in one pass."""

    def total(column: str, business: str | None = None):
        value = F.col(column) if business is None else F.when(F.col("business") == business, F.col(column))
        return F.coalesce(F.sum(value), F.lit(0))

    sums = clean.agg(
        total("amount", deposit).alias("deposits"),
        total("amount", withdrawal).alias("withdrawals"),
        total("fee").alias("fees"),
        total("stamp_duty").alias("stamp_duties"),
        total("transfer_fee").alias("transfer_fees"),
        F.count("*").alias("row_count"),
        F.lit(len(clean.columns)).cast("bigint").alias("column_count"),
    )
    return sums.withColumn("net_inflow", F.col("deposits") + F.col("withdrawals"))


def cleared_profit(profits: DataFrame, still_open: Sequence[str] = OPEN_POSITIONS) -> DataFrame:
    """Total profit of the securities that are no longer held."""
    closed = profits.where(contains_none(F.col("security"), still_open))
    return closed.agg(F.coalesce(F.sum("profit"), F.lit(0)).alias("cleared_profit"))
