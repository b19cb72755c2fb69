"""Vector columns for the searches: which rows take part, and how tasks read them.

Vectors of different lengths are compared as if the shorter ones ended in zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Not NULL, and without NULL, NaN or infinite components."""
    parts = vector.cast("array<double>")
    return F.coalesce(F.forall(parts, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)), F.lit(False))


def padded(vector: Column, size: int, zero: Column) -> Column:
    return F.concat(vector, F.array_repeat(zero, F.lit(size) - F.size(vector)))


def matrix(column: pa.ChunkedArray | pa.Array, size: int, kind: type) -> np.ndarray:
    """A column of arrays of equal size as one matrix, without a copy per row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, size)


def spread(rows: DataFrame, parts: int) -> Column:
    """A part for each row that depends on its place too, so repeated rows do not crowd one part."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties to the smaller vec_id, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
