"""Scans of market tables. Column lists and date ranges reach the parquet reader."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersift.functions.numeric import nan_to_null
from tickersift.sources.schemas import shaped

LISTED = "L"


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None
) -> DataFrame:
    """A stored table with NaN turned into NULL; with a logical schema, in its columns and types."""
    df = spark.read.parquet(path)
    df = shaped(df, schema) if schema else df
    return nan_to_null(df.select(*columns) if columns else df)


def listed_instruments(master: DataFrame, columns: Sequence[str] = ("symbol", "name", "area", "industry")) -> DataFrame:
    return master.where(F.col("list_status") == LISTED).select(*columns)


def snapshot(table: DataFrame, day: date, columns: Sequence[str] | None = None) -> DataFrame:
    """All symbols on one session."""
    rows = table.where(F.col("bar_date") == F.lit(day))
    return rows.select(*columns) if columns else rows


def between_dates(table: DataFrame, start: date, end: date, on: str = "bar_date") -> DataFrame:
    """Rows of all symbols in an inclusive date range, in one scan."""
    return table.where(F.col(on).between(F.lit(start), F.lit(end)))


def first_symbols(master: DataFrame, n: int) -> DataFrame:
    """The first ``n`` symbols in key order."""
    return master.orderBy("symbol").limit(n)
