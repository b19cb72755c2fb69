"""The trading calendar: which days were sessions, and their order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickersift.functions.dates import yyyymmdd

BACK = 5


def trading_calendar(days: DataFrame, on: str = "bar_date") -> DataFrame:
    """Distinct session dates with a dense index ``sess`` from 0.

    ``days`` may be the raw fact table: only its date column is read, and duplicates
    fall away before the shuffle. The index is numbered in one task, over distinct
    dates only: a few hundred rows per year of history, however many trades there are.
    """
    dates = days.select(F.col(on).alias("bar_date")).where(F.col("bar_date").isNotNull()).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("bar_date")
    return dates.select("bar_date", (F.row_number().over(order) - 1).cast("bigint").alias("sess"))


def session_offsets(calendar: DataFrame, back: int = BACK) -> DataFrame:
    """Each session with its neighbours t-1 ... t-back and t+1 as YYYYMMDD text."""
    order = Window.partitionBy(F.lit(0)).orderBy("sess")
    return calendar.select(
        "bar_date",
        "sess",
        yyyymmdd(F.col("bar_date")).alias("t"),
        *[yyyymmdd(F.lag("bar_date", k).over(order)).alias(f"t_b{k}") for k in range(1, back + 1)],
        yyyymmdd(F.lead("bar_date", 1).over(order)).alias("t_n1"),
    )


def with_session(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Attach ``sess`` by date. The calendar holds at most one row per day, so it is broadcast."""
    return rows.join(F.broadcast(calendar), "bar_date")


def sessions_around(calendar: DataFrame, day: date, back: int) -> tuple[date, date, date]:
    """The newest session t up to ``day``, with the one ``back`` sessions before it and the one after it.

    At either end of the calendar the nearest session there is stands in.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("sess")
    around = calendar.select(
        "bar_date",
        F.coalesce(F.lag("bar_date", back).over(order), F.min("bar_date").over(order)).alias("first"),
        F.coalesce(F.lead("bar_date", 1).over(order), F.col("bar_date")).alias("last"),
    )
    row = around.where(F.col("bar_date") <= F.lit(day)).orderBy(F.desc("bar_date")).first()
    if row is None:
        raise ValueError(f"no session up to {day}")
    return row["first"], row["bar_date"], row["last"]


def sessions_near(calendar: DataFrame, day: date, offsets: Sequence[int]) -> dict[int, date]:
    """The dates of the session ``day`` and of those at the given distances from it, as far as they exist: a handful of rows."""
    own = calendar.where(F.col("bar_date") == F.lit(day)).select(F.col("sess").alias("own"))
    # One row, or none if the day was no session.
    found = calendar.join(F.broadcast(own.limit(1)), (F.col("sess") - F.col("own")).isin([0, *offsets])).select(F.col("sess") - F.col("own"), "bar_date")
    dates = {int(k): d for k, d in found.collect()}
    if 0 not in dates:
        raise ValueError(f"{day} was no session")
    return dates
