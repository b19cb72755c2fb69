"""Pattern matching over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(regex: str, across_lines: bool = False) -> str:
    """Add flags so that ``.`` stops at ``\\n`` only, or at nothing at all.

    Java's ``.`` also stops at ``\\r`` and three Unicode separators; ``(?d)`` makes
    the line feed the only line end.
    """
    return ("(?ds)" if across_lines else "(?d)") + regex


def contains_any(col: Column, alternatives: Sequence[str] | str) -> Column:
    return col.rlike(_alternation(alternatives))


def contains_none(col: Column, alternatives: Sequence[str] | str) -> Column:
    """True where no alternative occurs; NULL text gives NULL, so a filter drops it."""
    return ~col.rlike(_alternation(alternatives))


def _alternation(alternatives: Sequence[str] | str) -> str:
    return alternatives if isinstance(alternatives, str) else "|".join(alternatives)


def first_match(col: Column, regex: str, group: int = 1) -> Column:
    """Group of the first match: NULL without a match, '' for an empty group.

    The long text is searched once; the group is then cut out of the short match.
    """
    return F.regexp_extract(F.regexp_substr(col, F.lit(regex)), regex, group)


def all_matches(col: Column, regex: str) -> Column:
    """Every whole match, in order, as an array."""
    return F.regexp_extract_all(col, F.lit(regex), F.lit(0))


def explode_groups(df: DataFrame, matches: Column, regex: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per element of a match array, one column per capture group, ``pos`` counting from 0."""
    rows = df.select(*keep, F.posexplode(matches).alias("pos", "_match"))
    return rows.select(
        *keep, "pos", *[F.regexp_extract("_match", regex, i).alias(n) for i, n in enumerate(names, start=1)]
    )


def explode_matches(df: DataFrame, text: str, regex: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per match in a text column.

    The text is searched once for whole matches and the groups are cut out of each
    match, so the cost does not grow with the number of groups. This needs a regex
    whose ends do not look at the surrounding text (no look-around, ``^``, ``$``, ``\\b``).
    """
    return explode_groups(df, all_matches(F.col(text), regex), regex, names, keep)
