"""The daily job: screens for one session, best next-session return first."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersift.functions.numeric import keep
from tickersift.functions.scratch import staged
from tickersift.operators.bars import latest_averages, only_survivors
from tickersift.operators.calendar import BACK, sessions_around
from tickersift.operators.panel import session_panel
from tickersift.operators.ranking import ranked
from tickersift.plans.screens import DAILY, report
from tickersift.sources.market import between_dates


def by_next_return(rows: DataFrame) -> DataFrame:
    """Largest next-session change first, unknown changes last, ties by symbol."""
    return rows.orderBy(F.desc_nulls_last("pct_n1"), "symbol")


def daily_screens(
    bars: DataFrame, calendar: DataFrame, master: DataFrame, day: date, since: date, bounds: Mapping[str, object], stored: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Screens of :data:`DAILY` for the newest session up to ``day``, ready to show.

    See :func:`day_reports` for the arguments.
    """
    return {name: by_next_return(rows) for name, rows in day_reports(bars, calendar, master, day, since, bounds, stored).items()}


def daily_findings(
    bars: DataFrame, calendar: DataFrame, master: DataFrame, day: date, since: date, bounds: Mapping[str, object], stored: DataFrame | None = None
) -> DataFrame:
    """The same screens as one table: ``screen``, the report columns and each row's ``rank`` in its screen from 1."""
    found = day_reports(bars, calendar, master, day, since, bounds, stored)
    rows = reduce(DataFrame.unionByName, [df.withColumn("screen", F.lit(name)) for name, df in found.items()])
    return ranked(rows, [F.desc_nulls_last("pct_n1"), F.asc("symbol")], by="screen")


def day_reports(
    bars: DataFrame, calendar: DataFrame, master: DataFrame, day: date, since: date, bounds: Mapping[str, object], stored: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The reports of some screens for the newest session up to ``day``, in no order.

    ``bounds`` maps the names of the wanted screens to their bounds, or to None for the
    fixed ones. ``bars`` is a stored table with pre_close, pct_chg and the metric columns.
    A filter on the date cannot pass below a window ordered by date, so the scans
    themselves are bounded: one panel, made of seven sessions around the day, serves all
    screens. Only for the symbols that meet the row conditions of some screen is the
    history from ``since`` on read, once, and cut to the bars that the averages need.
    With ``stored`` averages (see :func:`~tickersift.operators.stored.stored_averages`) no
    history is read at all: besides the seven sessions of ``bars``, one date of that table.
    """
    first, t, last = sessions_around(calendar, day, BACK)
    panel = session_panel(between_dates(bars, first, last), calendar).where(F.col("bar_date") == F.lit(t))
    panel = staged(panel.join(master, "symbol"), "day-panel")
    found = {name: DAILY[name].rows(panel, b) for name, b in bounds.items()}

    tested = [name for name in found if DAILY[name].average_conditions()]
    if tested:
        lengths = sorted({n for name in tested for n in DAILY[name].averages})
        symbols = reduce(DataFrame.union, [found[name].select("symbol") for name in tested])
        if stored is None:
            averages = latest_averages(only_survivors(between_dates(bars, since, t), symbols), lengths)
        else:
            averages = between_dates(stored, t, t)
        averages = averages.select("symbol", "scaled_close", "scaled_low", *[f"ma{n}_sum" for n in lengths])
        averages = staged(averages, "day-averages") if len(tested) > 1 else averages
        for name in tested:
            rows = keep(averages, *DAILY[name].average_conditions()).join(found[name], "symbol")
            found[name] = rows.select(*panel.columns)
    return {name: report(rows) for name, rows in found.items()}


def daily_screen(
    name: str, bars: DataFrame, calendar: DataFrame, master: DataFrame, day: date, since: date, bounds=None
) -> DataFrame:
    """One screen for one day, see :func:`daily_screens`."""
    return daily_screens(bars, calendar, master, day, since, {name: bounds})[name]
