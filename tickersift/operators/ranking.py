"""Row numbers over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged

# monotonically_increasing_id() keeps the partition number above this many bits.
ROW_BITS = 33


def ranked(df: DataFrame, order: Sequence[Column], by: str | None = None, name: str = "rank") -> DataFrame:
    """Number rows from 1 in a total order, over the table or within each ``by`` value.

    A window would send a whole group to one task. Here the rows are range-partitioned
    and sorted, numbered inside each partition, and shifted by the number of rows that
    earlier partitions hold for the same group. The rows are written out once before
    they are sampled for the ranges, so they are not computed twice, and once more when
    numbered, so rows and counts cannot disagree. ``by`` should have few distinct values
    (dates): the counts have one row per partition and value met in it.
    """
    group = [F.col(by)] if by else []
    ordered = staged(df, "unranked").repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    numbered = staged(ordered.withColumn("_pos", F.monotonically_increasing_id()), "ranked")
    numbered = numbered.withColumn("_part", F.shiftright("_pos", ROW_BITS))
    earlier = Window.partitionBy("_group").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy((F.col(by) if by else F.lit(0)).alias("_group"), F.col("_part").alias("_run"))
        .agg(F.min("_pos").alias("_start"), F.count("*").alias("_rows"))
        .select("_group", "_run", "_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    same_run = F.col("_part") == F.col("_run")
    if by:
        same_run &= F.col(by).eqNullSafe(F.col("_group"))
    rank = F.col("_before") + F.col("_pos") - F.col("_start") + 1
    return numbered.join(offsets, same_run).select(*df.columns, rank.cast("bigint").alias(name))
