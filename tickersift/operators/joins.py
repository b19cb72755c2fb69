"""Joins against tables with unique keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def lookup(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join ``left``, where one key may hold a large part of the rows, with a small-key table.

    Rows of a hot key are spread over ``salts`` tasks by a hash of the ``spread``
    columns (which should tell rows of one key apart); ``right`` is repeated once per
    salt, so pass it with few columns and unique, or nearly unique, keys. The salt is
    a function of the row, so a task that runs again yields the same rows.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def lookup_wide(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """Inner join like :func:`lookup` for a ``right`` too wide to repeat for every salt.

    The (key, salt) pairs that ``left`` uses are counted out first, so a right row is
    copied only as often as it is needed: once for a rare key, ``salts`` times for a hot
    one. ``left`` is read twice; stage it when it is costly.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    needed = salted.select(*on, "_salt").distinct()
    return salted.join(right.join(needed, list(on)), [*on, "_salt"]).drop("_salt")
