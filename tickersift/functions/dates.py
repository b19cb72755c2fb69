"""Date column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit years from 69 on belong to the 1900s, and Spark's `yy`
# reads every two-digit year as 20yy.
FIRST_YEAR_READ_TOO_LATE = 2069
MONTHS_PER_CENTURY = 1200


def yyyymmdd(col: Column) -> Column:
    return F.date_format(col, "yyyyMMdd")


def days_before(col: Column, days: int) -> Column:
    return F.date_sub(col, days)


def days_after(col: Column, days: int) -> Column:
    return F.date_add(col, days)


def lenient_short_date(col: Column) -> Column:
    """Parse ``yy/m/d`` text as a date; anything else becomes NULL."""
    parsed = F.try_to_timestamp(col, F.lit("yy/M/d")).cast("date")
    return F.when(
        F.year(parsed) >= FIRST_YEAR_READ_TOO_LATE, F.add_months(parsed, -MONTHS_PER_CENTURY)
    ).otherwise(parsed)


def week_start(col: Column) -> Column:
    return F.trunc(col.cast("date"), "week")
