"""Price bars: building, resampling, adjusting and averaging.

A bar table has at most one row per (symbol, bar_date), so a window over one
symbol's history never holds more rows than the trading calendar has sessions.
Raw trades have no such bound; they are only ever reduced by aggregates with a
map-side part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = "decimal(18,2)"
PRICE = "decimal(18,4)"
AVERAGES = (5, 10, 20, 30, 60)


def history() -> WindowSpec:
    """Each symbol's bars, oldest first. One spec for all operators, so that Spark sorts once."""
    return Window.partitionBy("symbol").orderBy("bar_date")


def own_scale(df: DataFrame, column: str) -> Column:
    """A decimal column as it is, any other number with four decimals."""
    return F.col(column) if isinstance(df.schema[column].dataType, DecimalType) else F.col(column).cast(PRICE)


def bars_from_trades(trades: DataFrame, session: Column, order: Sequence[str], hashed: bool = False) -> DataFrame:
    """Open, high, low, close and volume per symbol and session, in the scale of the prices.

    ``trades`` has symbol, price, qty and the ``order`` columns, time first, which together
    with price and qty decide the first and the last trade of a session. Trades without a
    symbol or a time are in no bar. Volumes that are not decimal are added up as whole
    ten-thousandths: exact, and cheaper than a wide decimal.

    By default the trades are read once; a least and a greatest row make Spark sort each
    task's trades before they are reduced. With ``hashed`` they are read twice and never
    sorted: numbers of fixed width are hashed to the span of time of each session, then
    only the trades at both ends of a span meet it again, and ties among them are settled.
    """
    exact = isinstance(trades.schema["qty"].dataType, DecimalType)
    volume = F.sum("qty") if exact else F.sum(F.rint(F.col("qty") * 10_000).cast("bigint"))
    totals = {"high": F.max("price"), "low": F.min("price"), "vol": volume}
    dated = trades.where(F.col("symbol").isNotNull() & F.col(order[0]).isNotNull()).select("symbol", session.alias("bar_date"), *order, "price", "qty")
    bars = _hashed(dated, order, totals) if hashed else _sorted(dated, order, totals)
    bars = bars.select("symbol", "bar_date", F.col("_first.price").alias("open"), "high", "low", F.col("_last.price").alias("close"), "vol")
    prices = {c: own_scale(bars, c) for c in ("open", "high", "low", "close")}
    return bars.withColumns(prices | ({} if exact else {"vol": (F.col("vol").cast("decimal(20,0)") / 10_000).cast(PRICE)}))


def _sorted(dated: DataFrame, order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    sequence = F.struct(*order, "price", "qty")
    ends = (F.min(sequence).alias("_first"), F.max(sequence).alias("_last"))
    return dated.groupBy("symbol", "bar_date").agg(*ends, *[v.alias(c) for c, v in totals.items()])


def _hashed(dated: DataFrame, order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    time, *ties = order
    span = (F.min(time).alias("_begin"), F.max(time).alias("_end"))
    spans = dated.groupBy("symbol", "bar_date").agg(*span, *[v.alias(c) for c, v in totals.items()])
    ends = spans.withColumn(time, F.explode(F.array_distinct(F.array("_begin", "_end"))))
    sequence = F.struct(*ties, "price", "qty")
    return (
        dated.join(ends, ["symbol", "bar_date", time])
        .groupBy("symbol", "bar_date")
        .agg(
            F.min(F.when(F.col(time) == F.col("_begin"), sequence)).alias("_first"),
            F.max(F.when(F.col(time) == F.col("_end"), sequence)).alias("_last"),
            *[F.max(c).alias(c) for c in totals],
        )
    )


def resample(bars: DataFrame, period: str) -> DataFrame:
    """Weekly or monthly bars, dated by the first day of the period."""
    start = F.trunc("bar_date", period)
    return bars.groupBy("symbol", start.alias("bar_date")).agg(
        F.min_by("open", F.col("bar_date")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.col("bar_date")).alias("close"),
        F.sum("vol").cast(bars.schema["vol"].dataType).alias("vol"),
    )


def percent_change(bars: DataFrame) -> DataFrame:
    """Previous close (the symbol's own last bar) and the change against it in percent."""
    pre, close = F.col("pre_close").cast("double"), F.col("close").cast("double")
    return bars.withColumn("pre_close", F.lag("close").over(history())).withColumn(
        "pct_chg", F.try_divide(F.lit(100.0) * (close - pre), pre)
    )


def forward_adjusted(bars: DataFrame, columns: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices scaled to the newest adjustment factor of each symbol, as doubles.

    The newest factor is a running first value over the newest-first history, which
    streams instead of holding the whole history in memory.
    """
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("bar_date")).rowsBetween(Window.unboundedPreceding, 0)
    newest = F.first("adj_factor").over(newest_first).cast("double")
    factor = F.col("adj_factor").cast("double")
    return (
        bars.withColumn("_newest", newest)
        .withColumns({c: F.col(c).cast("double") * factor / F.col("_newest") for c in columns})
        .drop("_newest")
    )


def adjustable(bars: DataFrame, column: str) -> Column:
    """A price on one scale over the whole history: times its factor, if there is one.

    The type leaves room for an exact sum and for an exact product with a bar count.
    """
    if "adj_factor" not in bars.columns:
        return F.col(column)
    return (F.col(column) * F.col("adj_factor")).cast("decimal(26,8)")


def moving_averages(bars: DataFrame, lengths: Sequence[int] = AVERAGES) -> DataFrame:
    """Add ``ma<n>`` and the exact ``ma<n>_sum`` over the last n bars of a symbol.

    Both are NULL until n bars exist, or when one of the n closes is missing. Sums are
    differences of one running decimal total, so the cost per row does not depend on
    n and no rounding enters. With an ``adj_factor`` column the closes are put on one
    scale first: ``ma<n>_sum`` is on that scale (compare it with ``n * scaled_close``)
    and ``ma<n>`` is scaled back to the row's own prices.
    """
    own = history()
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    base = bars.withColumns({"scaled_close": adjustable(bars, "close"), "scaled_low": adjustable(bars, "low")})
    totals = base.withColumns(
        {
            "_total": F.coalesce(F.sum("scaled_close").over(running), F.lit(0)),
            "_count": F.count("scaled_close").over(running),
        }
    )
    sums = totals.withColumns(
        {
            f"ma{n}_sum": F.when(
                F.col("_count") - F.lag("_count", n, 0).over(own) == n,
                F.col("_total") - F.coalesce(F.lag("_total", n).over(own), F.lit(0)),
            )
            for n in lengths
        }
    ).drop("_total", "_count")
    return sums.withColumns({f"ma{n}": _average(bars, F.col(f"ma{n}_sum"), n) for n in lengths})


def _average(bars: DataFrame, total: Column, n: int) -> Column:
    mean = total.cast("double") / F.lit(float(n))
    return mean / F.col("adj_factor").cast("double") if "adj_factor" in bars.columns else mean


def latest_rows(bars: DataFrame, n: int = 1) -> DataFrame:
    """The newest n bars of each symbol, ``age`` 1 being the newest.

    A filter on a row number lets Spark cut each symbol down to n rows before the
    shuffle as well as after it.
    """
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("bar_date"))
    rows = bars.withColumn("age", F.row_number().over(newest_first)).where(F.col("age") <= n)
    return rows.withColumn("age", F.col("age").cast("bigint"))


def latest_averages(bars: DataFrame, lengths: Sequence[int] = AVERAGES) -> DataFrame:
    """Close, low and the columns of :func:`moving_averages` at each symbol's newest bar.

    Only the newest ``max(lengths)`` bars of a symbol travel; the sums are conditional
    aggregates over them.
    """
    prices = {"scaled_close": adjustable(bars, "close"), "scaled_low": adjustable(bars, "low")}
    recent = latest_rows(bars.withColumns(prices), max(lengths))
    at_newest = ["close", "low", *prices, *(["adj_factor"] if "adj_factor" in bars.columns else [])]

    def total(n: int) -> Column:
        inside = F.when(F.col("age") <= n, F.col("scaled_close"))
        return F.when(F.count(inside) == n, F.sum(inside))

    sums = recent.groupBy("symbol").agg(
        F.max("bar_date").alias("bar_date"),
        *[F.max(F.when(F.col("age") == 1, F.col(c))).alias(c) for c in at_newest],
        *[total(n).alias(f"ma{n}_sum") for n in lengths],
    )
    return sums.withColumns({f"ma{n}": _average(bars, F.col(f"ma{n}_sum"), n) for n in lengths})


def only_survivors(bars: DataFrame, survivors: DataFrame) -> DataFrame:
    """Bars of the symbols that came through a screen."""
    return bars.join(survivors.select("symbol").distinct(), "symbol", "left_semi")
