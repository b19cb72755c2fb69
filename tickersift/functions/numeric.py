"""Numeric column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEN_THOUSAND = 10000


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column.

    Spark orders NaN above all numbers, so a NaN would pass ``>=`` filters that a
    missing metric has to fail.
    """
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )


def lenient_decimal(col: Column, precision: int = 38, scale: int = 10) -> Column:
    """Parse text as a number; text that is not a number becomes NULL."""
    return F.trim(col).try_cast(f"decimal({precision},{scale})")


def to_hundred_millions(col: Column) -> Column:
    """Rescale a figure given in ten-thousands to hundred-millions."""
    return col / F.lit(TEN_THOUSAND)


def body_ratio(open_: Column, close: Column) -> Column:
    """Candle body relative to the open; NULL for a zero open."""
    o, c = open_.cast("double"), close.cast("double")
    return F.try_divide(F.abs(o - c), o)


def grew_by(now: Column, before: Column, factor: float) -> Column:
    """``now / before >= factor``, where growth from zero counts as unbounded."""
    from_zero = (before == 0) & (now > 0)
    return from_zero | (F.try_divide(now, before) >= F.lit(factor))


def never_rising(*cols: Column) -> Column:
    """Each column is at least as large as the one after it: x >= y >= z ..."""
    return reduce(and_, [a >= b for a, b in zip(cols, cols[1:])])


def within(col: Column, low=None, high=None) -> list[Column]:
    """Inclusive bounds as a list of predicates; a bound of None is left out."""
    bounds = []
    if low is not None:
        bounds.append(col >= F.lit(low))
    if high is not None:
        bounds.append(col <= F.lit(high))
    return bounds


def keep(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that satisfy every condition; an unknown (NULL) condition fails."""
    return df.where(reduce(and_, conditions))
