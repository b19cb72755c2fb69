"""The session panel: each bar next to its neighbours on the market calendar."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickersift.operators.bars import history
from tickersift.operators.calendar import BACK, sessions_near, with_session

# Sessions whose returns stand beside a quote: one and two before it, and the next.
NEIGHBOURS = (-1, -2, 1)


def offset_name(column: str, k: int) -> str:
    return f"{column}_{'b' if k < 0 else 'n'}{abs(k)}"


def neighbour_returns(bars: DataFrame, calendar: DataFrame, offsets: Sequence[int] = NEIGHBOURS, column: str = "pct_chg", name: str = "pct") -> DataFrame:
    """Bars with a measure of the sessions around them: ``pct_b1`` is that of the session before, ``pct_n1`` of the next.

    A frame of the one session at that distance finds the symbol's bar of it or none,
    whatever sessions between are missing. All frames share one shuffle and one sort.
    A bar whose date is no session of the calendar is left out.
    """
    by_session = Window.partitionBy("symbol").orderBy("sess")
    found = {offset_name(name, k): F.first(column).over(by_session.rangeBetween(k, k)) for k in offsets}
    return with_session(bars, calendar).withColumns(found)


def listed_returns(
    master: DataFrame, bars: DataFrame, calendar: DataFrame, day: date, columns: Sequence[str], offsets: Sequence[int] = NEIGHBOURS, column: str = "pct_chg", name: str = "pct"
) -> DataFrame:
    """Every instrument of ``master`` with its quote of one session and the returns of the sessions around it.

    What an instrument lacks is NULL, also if it lacks the day itself. Only the sessions
    named are read; one aggregate by symbol lays them side by side. ``day`` is a session.
    """
    near = sessions_near(calendar, day, offsets)
    days = {k: near.get(k) for k in (0, *offsets)}
    read = bars.where(F.col("bar_date").isin([d for d in days.values() if d is not None]))

    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("bar_date") == F.lit(days[k]).cast("date"), F.col(c)))

    own = {c: at(0, c) for c in columns}
    around = {offset_name(name, k): at(k, column) for k in offsets}
    wide = read.groupBy("symbol").agg(*[v.alias(c) for c, v in {**own, **around}.items()])
    return master.join(wide, "symbol", "left").withColumn("bar_date", F.lit(day))


def session_panel(bars: DataFrame, calendar: DataFrame, back: int = BACK) -> DataFrame:
    """Bars that also traded on each of the ``back`` sessions before, side by side.

    Adds ``tor_b<k>``, ``high_b<k>``, ``low_b<k>``, the changes ``pct_b1`` and ``pct_b2``
    and the next session's change ``pct_n1`` (NULL when the symbol did not trade then).
    Offsets are sessions of the market, not rows of the symbol: as ``sess`` is unique
    within a symbol, a fifth earlier row exactly five sessions back proves that no
    session in between is missing. One shuffle by symbol serves every column.
    """
    rows = with_session(bars, calendar)
    own = history()

    def before(name: str, k: int) -> Column:
        return F.lag(name, k).over(own)

    wide = rows.withColumns(
        {
            "_reach": before("sess", back),
            **{f"{c}_b{k}": before(c, k) for c in ("tor", "high", "low") for k in range(1, back + 1)},
            "pct_b1": before("pct_chg", 1),
            "pct_b2": before("pct_chg", 2),
            "pct_n1": F.when(F.lead("sess", 1).over(own) == F.col("sess") + 1, F.lead("pct_chg", 1).over(own)),
        }
    )
    return wide.where(F.col("_reach") == F.col("sess") - back).drop("_reach")
