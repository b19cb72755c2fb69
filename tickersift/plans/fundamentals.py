"""Fundamental screens and report joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersift.functions.numeric import keep, to_hundred_millions, within

SHARES_AND_VALUES = ("float_share", "total_share", "total_mv", "circ_mv")


# The bounds of both screens, in hundred-millions, prices and per-share amounts.
@dataclass(frozen=True)
class HighTransfer:
    close_min: float = 25
    capital_rese_ps_min: float = 2
    eps_min: float = 0.5
    total_share_max: float | None = 3
    float_share_max: float | None = 1
    total_mv_max: float | None = 100


@dataclass(frozen=True)
class SmallCap:
    float_share_max: float = 3
    total_mv_max: float = 20
    close_max: float = 25
    pe_above: float = 0
    pe_max: float = 60


def snapshot_enrich(master: DataFrame, metrics: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Every instrument with its metrics, and optionally its bar, of one session.

    All three tables hold one row per symbol; instruments that did not trade keep NULLs.
    """
    rows = metrics
    if bars is not None:
        rows = metrics.join(bars, ["symbol", "bar_date"], "left")
    return master.join(rows, "symbol", "left")


def rescaled(df: DataFrame) -> DataFrame:
    """Shares and market values from ten-thousands to hundred-millions."""
    return df.withColumns({c: to_hundred_millions(F.col(c)) for c in SHARES_AND_VALUES if c in df.columns})


def high_transfer(quotes: DataFrame, indicators: DataFrame, b: HighTransfer = HighTransfer()) -> DataFrame:
    """Dear, small, well-earning stocks with large reserves; one row per matching report."""
    joined = rescaled(quotes).join(indicators.select("symbol", "report_end", "capital_rese_ps", "eps"), "symbol")
    return keep(
        joined,
        F.col("close") >= b.close_min,
        F.col("capital_rese_ps") >= b.capital_rese_ps_min,
        F.col("eps") >= b.eps_min,
        *within(F.col("total_share"), high=b.total_share_max),
        *within(F.col("float_share"), high=b.float_share_max),
        *within(F.col("total_mv"), high=b.total_mv_max),
    )


def small_cap(metrics: DataFrame, b: SmallCap = SmallCap()) -> DataFrame:
    """Small, cheap, profitable stocks, largest market value first."""
    return keep(
        rescaled(metrics),
        F.col("float_share") <= b.float_share_max,
        F.col("total_mv") <= b.total_mv_max,
        F.col("close") <= b.close_max,
        F.col("pe") > b.pe_above,
        F.col("pe") <= b.pe_max,
    ).orderBy(F.desc_nulls_last("total_mv"), "symbol", "bar_date")


def latest_reports(downloads: DataFrame, version: str, key: Sequence[str] = ("symbol", "report_end")) -> DataFrame:
    """One row per key of a table that repeats reports: the values of the newest version.

    Columns are taken one by one, by the newest version: flat buffers, so that Spark hashes
    instead of sorting, and copies meet before the shuffle. A version of a key has one set
    of values; where it has several, each column has one of them.
    """
    values = [c for c in downloads.columns if c not in (*key, version)]
    newest = downloads.where(F.col(version).isNotNull()).groupBy(*key).agg(*[F.max_by(F.col(c), F.col(version)).alias(c) for c in values])
    return newest.select(*[c for c in downloads.columns if c != version])


def fundamentals_join(indicators: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every financial report with the newest snapshot of its stock."""
    return indicators.join(quotes, "symbol", "left")


def forecast_enrich(forecasts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every earnings forecast with the enriched snapshot of its stock, if there is one."""
    return forecasts.join(quotes, "symbol", "left")
