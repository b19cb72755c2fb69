"""Bar tables that are kept between jobs: by symbol for back-tests, averages by date for daily jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersift.operators.bars import AVERAGES, latest_rows, moving_averages


def bars_by_symbol(bars: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Store bars in buckets by symbol, each one file sorted by symbol and date, and read them back.

    Windows, aggregates and joins by symbol over the table need no shuffle. ``buckets``
    defaults to the number of shuffle partitions; a bucket should fit in a task's memory
    for sorting. The table is known to this session by a name of its own; its files stay
    at ``path``. A symbol's history is as long as the calendar at most, so no bucket is
    filled by one symbol.
    """
    spark = bars.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bars_{uuid.uuid4().hex}"
    gathered = bars.repartition(n, "symbol")  # the partitions are the buckets, so each is one file
    gathered.write.bucketBy(n, "symbol").sortBy("symbol", "bar_date").option("path", path).saveAsTable(name)
    return spark.table(name)


# Averages by date. Below one folder lie ``averages``, partitioned by bar_date, and ``ends``,
# partitioned by the day ``through`` which a run went: the newest bars of each symbol then,
# as many as the longest average looks back.


def start_averages(bars: DataFrame, path: str, until: date, lengths: Sequence[int] = AVERAGES) -> None:
    """Store the sums of :func:`moving_averages` of all bars up to the day ``until``."""
    _add(bars.where(F.col("bar_date") <= F.lit(until)), None, path, until, lengths)


def append_averages(bars: DataFrame, path: str, until: date, lengths: Sequence[int] = AVERAGES) -> None:
    """Add the sums of the bars after the last run before ``until``, up to that day.

    Only those bars and the ends of that run are read, never the history, and the sums are
    those that the whole history gives. A run can be repeated: it replaces its own dates
    only. If it corrects bars, later runs have to be repeated after it. ``lengths`` are those
    of the start; of ``ends``, only the newest folder is needed by the next run.
    """
    ends = bars.sparkSession.read.parquet(f"{path}/ends")
    before = ends.where(F.col("through") < F.lit(until)).agg(F.max("through")).first()[0]
    if before is None:
        raise ValueError(f"no averages are stored up to a day before {until}")
    known = ends.where(F.col("through") == F.lit(before)).drop("through")
    fresh = bars.where((F.col("bar_date") > F.lit(before)) & (F.col("bar_date") <= F.lit(until)))
    _add(fresh, known, path, until, lengths)


def _add(fresh: DataFrame, known: DataFrame | None, path: str, until: date, lengths: Sequence[int]) -> None:
    needed = ["symbol", "bar_date", "close", "low", *(["adj_factor"] if "adj_factor" in fresh.columns else [])]
    rows = fresh.select(*needed).withColumn("_fresh", F.lit(True))
    if known is not None:
        rows = known.select(*needed).withColumn("_fresh", F.lit(False)).unionByName(rows)
    sums = moving_averages(rows, lengths).where("_fresh")
    kept = sums.select("symbol", "bar_date", "scaled_close", "scaled_low", *[f"ma{n}_sum" for n in lengths])
    _replace(kept, f"{path}/averages", "bar_date")
    ends = latest_rows(rows.select(*needed), max(1, max(lengths) - 1)).drop("age")
    _replace(ends.withColumn("through", F.lit(until)), f"{path}/ends", "through")


def _replace(rows: DataFrame, path: str, on: str) -> None:
    writer = rows.hint("rebalance", F.col(on)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(on).parquet(path)


def stored_averages(spark: SparkSession, path: str) -> DataFrame:
    """Rows (symbol, bar_date, scaled_close, scaled_low, ma<n>_sum); a filter on the date reads that date's folder only."""
    return spark.read.parquet(f"{path}/averages")
