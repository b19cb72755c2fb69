"""Multi-session screens over the session panel.

A screen can look at every (symbol, session) of the panel at once, or at one day of it
(see :mod:`tickersift.plans.daily`). Bounds default to the screens' own fixed values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersift.functions.numeric import body_ratio, grew_by, keep, never_rising, within
from tickersift.functions.text import contains_any
from tickersift.operators.bars import AVERAGES, history, latest_rows

REPORT = (
    "symbol",
    "name",
    "area",
    "industry",
    "close_adj",
    "close",
    "bar_date",
    "pct_chg",
    "pct_n1",
    "pe",
    "pe_ttm",
)


@dataclass(frozen=True)
class SteadyTurnover:
    turnover_min: float = 9
    turnover_max: float = 30
    pe_min: float = 10
    pe_max: float = 150
    close_min: float = 18
    close_max: float = 60


@dataclass(frozen=True)
class ValleyTurnover:
    turnover_min: float = 4
    turnover_b1_min: float = 3.6
    close_min: float = 5
    close_max: float = 60
    pe_min: float = 10
    pe_max: float = 200
    pe_ttm_min: float = 10


@dataclass(frozen=True)
class VShape:
    change_above: float = -1
    change_below: float = 3
    turnover_min: float = 3


@dataclass(frozen=True)
class RisingLows:
    change_max: float = 4
    close_min: float = 10
    close_max: float = 80
    pe_min: float = 5
    pe_ttm_min: float = 10


@dataclass(frozen=True)
class Doji:
    body_max: float = 0.005
    change_min: float = 0.02
    change_max: float = 2
    next_change_min: float = -1
    next_change_max: float = 3
    look_ahead: bool = True
    areas: tuple[str, ...] = ("江苏", "浙江", "上海", "广东", "深圳", "北京")
    turnover_min: float = 4
    turnover_b1_min: float = 4
    pe_min: float = 10
    pe_max: float = 200
    pe_ttm_min: float = 10


@dataclass(frozen=True)
class CrossAllAverages:
    close_min: float | None = 5
    close_max: float | None = 40
    pe_min: float = 15
    pe_max: float = 80
    pe_ttm_min: float | None = 15
    turnover_min: float = 4


@dataclass(frozen=True)
class TurnoverSurge:
    close_min: float = 10
    factor: float = 3


def at_or_above(n: int) -> Column:
    """Close at or above its n-bar average, on exact sums."""
    return F.col("scaled_close") * n >= F.col(f"ma{n}_sum")


def crosses(n: int) -> list[Column]:
    """A bar with its low below and its close above the n-bar average."""
    return [F.col("scaled_close") * n > F.col(f"ma{n}_sum"), F.col("scaled_low") * n < F.col(f"ma{n}_sum")]


def steady_turnover(b: SteadyTurnover) -> list[Column]:
    """Turnover within bounds on four sessions in a row."""
    four = ("tor", "tor_b1", "tor_b2", "tor_b3")
    return [
        *[c for name in four for c in within(F.col(name), b.turnover_min, b.turnover_max)],
        *within(F.col("pe"), b.pe_min, b.pe_max),
        *within(F.col("close"), b.close_min, b.close_max),
    ]


def valley_turnover(b: ValleyTurnover) -> list[Column]:
    """Turnover that fell over four sessions and picks up today."""
    return [
        F.col("tor") >= F.col("tor_b1"),
        never_rising(F.col("tor_b4"), F.col("tor_b3"), F.col("tor_b2"), F.col("tor_b1")),
        F.col("tor") >= b.turnover_min,
        F.col("tor_b1") >= b.turnover_b1_min,
        *within(F.col("close"), b.close_min, b.close_max),
        *within(F.col("pe"), b.pe_min, b.pe_max),
        F.col("pe_ttm") >= b.pe_ttm_min,
    ]


def v_shape(b: VShape) -> list[Column]:
    """Falling highs into today, without a gap upwards."""
    return [
        never_rising(F.col("high_b3"), F.col("high_b2"), F.col("high_b1"), F.col("high")),
        F.col("pct_chg") > b.change_above,
        F.col("pct_chg") < b.change_below,
        F.col("low") <= F.col("high_b1"),
        F.col("tor") >= b.turnover_min,
        F.col("tor_b1") >= b.turnover_min,
    ]


def rising_lows(b: RisingLows) -> list[Column]:
    """Four sessions of rising lows with small gains."""
    return [
        never_rising(F.col("low"), F.col("low_b1"), F.col("low_b2"), F.col("low_b3")),
        *[F.col(c) <= b.change_max for c in ("pct_chg", "pct_b1", "pct_b2")],
        *within(F.col("close"), b.close_min, b.close_max),
        F.col("pe") >= b.pe_min,
        F.col("pe_ttm") >= b.pe_ttm_min,
    ]


def doji(b: Doji) -> list[Column]:
    """A small rising body in chosen areas.

    ``look_ahead`` also bounds the next session's change, which only a back-test knows.
    """
    return [
        F.col("open") <= F.col("close"),
        body_ratio(F.col("open"), F.col("close")) <= b.body_max,
        *within(F.col("pct_chg"), b.change_min, b.change_max),
        *(within(F.col("pct_n1"), b.next_change_min, b.next_change_max) if b.look_ahead else []),
        contains_any(F.col("area"), b.areas),
        F.col("tor") >= b.turnover_min,
        F.col("tor_b1") >= b.turnover_b1_min,
        *within(F.col("pe"), b.pe_min, b.pe_max),
        F.col("pe_ttm") >= b.pe_ttm_min,
    ]


def cross_all_averages(b: CrossAllAverages) -> list[Column]:
    """Price, earnings and turnover bounds of the bars to test against all averages."""
    return [
        *within(F.col("close"), b.close_min, b.close_max),
        *within(F.col("pe"), b.pe_min, b.pe_max),
        *within(F.col("pe_ttm"), b.pe_ttm_min),
        F.col("tor") >= b.turnover_min,
    ]


def turnover_surge(b: TurnoverSurge) -> list[Column]:
    """Turnover at least ``factor`` times that of the session before."""
    return [F.col("close") >= b.close_min, grew_by(F.col("tor"), F.col("tor_b1"), b.factor)]


@dataclass(frozen=True)
class Screen:
    """Conditions on the panel row, then conditions on its moving averages."""

    bounds: type
    row_conditions: Callable[..., list[Column]]
    average_conditions: Callable[[], list[Column]] = list
    averages: tuple[int, ...] = ()

    def rows(self, panel: DataFrame, bounds=None) -> DataFrame:
        """Panel rows that meet the first part; needs no averages."""
        return keep(panel, *self.row_conditions(bounds or self.bounds()))

    def survivors(self, panel: DataFrame, bounds=None) -> DataFrame:
        """Panel rows that meet both parts; the panel carries :attr:`averages`."""
        found = self.rows(panel, bounds)
        conditions = self.average_conditions()
        return keep(found, *conditions) if conditions else found


DAILY: dict[str, Screen] = {
    # The 20-bar average is attached but is not a condition.
    "steady_turnover": Screen(SteadyTurnover, steady_turnover, list, (20,)),
    "valley_turnover": Screen(ValleyTurnover, valley_turnover, lambda: [at_or_above(20), at_or_above(60)], (20, 60)),
    "v_shape": Screen(VShape, v_shape, lambda: [at_or_above(20)], (20,)),
    "rising_lows": Screen(RisingLows, rising_lows, lambda: [at_or_above(5)], (5,)),
    "doji": Screen(Doji, doji),
    "cross_all_averages": Screen(
        CrossAllAverages, cross_all_averages, lambda: [c for n in AVERAGES for c in crosses(n)], AVERAGES
    ),
    "turnover_surge": Screen(TurnoverSurge, turnover_surge, lambda: [at_or_above(5)], (5,)),
}


def all_survivors(panel: DataFrame, bounds: Mapping[str, object]) -> DataFrame:
    """The survivors of several screens in one pass: a panel row once for each ``screen`` that it comes through.

    ``bounds`` maps names of :data:`DAILY` to their bounds, or to None for the fixed ones;
    the panel carries the averages of all of them.
    """
    met = []
    for name, b in bounds.items():
        screen = DAILY[name]
        conditions = [*screen.row_conditions(b or screen.bounds()), *screen.average_conditions()]
        met.append(F.when(reduce(and_, conditions), F.lit(name)))
    return panel.withColumn("screen", F.explode(F.array_compact(F.array(*met))))


def report(survivors: DataFrame, *more: str) -> DataFrame:
    """The common report columns of a screen, behind ``more`` of its columns.

    The close adjusted as of a bar's own date is that bar's close, since the newest
    factor then is its own.
    """
    return survivors.withColumn("close_adj", F.col("close")).select(*more, *REPORT)


def weekly_rising(weekly: DataFrame) -> DataFrame:
    """Weekly bars whose high, close, open and low rose, or held, over three bars of the symbol."""
    fields = ("high", "close", "open", "low")
    rows = weekly.withColumns({f"_{c}{k}": F.lag(c, k).over(history()) for c in fields for k in (1, 2)})
    tests = [never_rising(F.col(c), F.col(f"_{c}1"), F.col(f"_{c}2")) for c in fields]
    return keep(rows, *tests).select(*weekly.columns)


def weekly_rising_now(weekly: DataFrame) -> DataFrame:
    """The same test at the newest bar of each symbol only, reading three bars per symbol."""
    fields = ("high", "close", "open", "low")
    recent = latest_rows(weekly, 3)

    def at(column: str, age: int) -> Column:
        return F.max(F.when(F.col("age") == age, F.col(column)))

    wide = recent.groupBy("symbol").agg(
        F.max("bar_date").alias("bar_date"), *[at(c, k).alias(f"_{c}{k}") for c in fields for k in (1, 2, 3)]
    )
    tests = [never_rising(*[F.col(f"_{c}{k}") for k in (1, 2, 3)]) for c in fields]
    return keep(wide, *tests).select("symbol", "bar_date", *[F.col(f"_{c}1").alias(c) for c in fields])
