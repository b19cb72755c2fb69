"""Market-shaped inputs derived from the driver tables (see FIXTURES.md)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersift.functions.charset import representable
from tickersift.functions.dates import week_start
from tickersift.functions.numeric import nan_to_null
from tickersift.operators.bars import MONEY, bars_from_trades, percent_change
from tickersift.operators.calendar import trading_calendar
from tickersift.operators.joins import lookup
from tickersift.sources.market import listed_instruments

TRADE_ORDER = ("ts", "l_orderkey", "l_linenumber")
DAYS_PER_WEEK = 7


# Columns of the driver tables. A known schema saves a look into the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet"))


def trades(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Line items as trades of their supplier; the week bounds reach the parquet reader."""
    rows = table(spark, sf_dir, "lineitem")
    if start:
        rows = rows.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        after = end + timedelta(days=DAYS_PER_WEEK)
        rows = rows.where(F.col("l_shipdate") < F.lit(after).cast("timestamp_ntz"))
    return rows.select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
    )


def weekly_bars(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    return bars_from_trades(trades(spark, sf_dir, start, end), week_start(F.col("ts")), TRADE_ORDER)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_trades(trades(spark, sf_dir), F.col("ts").cast("date"), TRADE_ORDER, hashed=True)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the weekly bars, read from the ship dates alone."""
    days = table(spark, sf_dir, "lineitem").select(week_start(F.col("l_shipdate")).alias("bar_date"))
    return trading_calendar(days)


def with_metrics(bars: DataFrame) -> DataFrame:
    """Daily metrics of a bar; shares and market values in ten-thousands."""
    close = F.col("close").cast("double")
    shares = (F.lit(100) + F.col("symbol") % 5 * 20).cast("double")
    issued = (F.lit(2) + F.col("symbol") % 3).cast("double")
    eps = (F.lit(1000) + F.col("symbol") % 20 * 50).cast("double")
    return bars.withColumns(
        {
            "pe": close / eps,
            "pe_ttm": close / (eps + 200),
            "pb": F.lit(None).cast("double"),
            "float_share": shares * 10000,
            "total_share": shares * issued * 10000,
            "total_mv": close * shares * issued,
            "circ_mv": close * shares,
            "tor": F.lit(100.0) * F.col("vol").cast("double") / shares,
        }
    )


def quoted_bars(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Weekly bars with previous close, change and metrics."""
    return with_metrics(percent_change(weekly_bars(spark, sf_dir, start, end)))


def with_factor(bars: DataFrame) -> DataFrame:
    """A price adjustment factor that grows by a tenth every year."""
    factor = (F.lit(1) + (F.year("bar_date") - 1995).cast("decimal(10,1)") / 10).cast("decimal(10,2)")
    return bars.withColumn("adj_factor", factor)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as instruments; those with a negative balance count as delisted ('D')."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("s_suppkey").alias("symbol"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("area"),
            F.col("r_name").alias("industry"),
            F.when(F.col("s_acctbal") < 0, "D").otherwise("L").alias("list_status"),
        )
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


SITE = "https://pages.example"
LINK_START = '<li><a href="'


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with an address of their own, and links to the pages around them.

    The n-th link of page p names page p + 3n - 8, in turn as an absolute address, by
    host, by path and relative to the page's folder; some lead to no page.
    """

    def linked(piece: Column, n: Column) -> Column:
        target = (F.col("page_id") + n * 3 - 8).cast("string")
        form = F.element_at(
            F.array(F.lit(""), F.lit(f"{SITE}/pages/"), F.lit("//pages.example/pages/"), F.lit("/pages/")), n % 4 + 1
        )
        href = F.concat(form, target)
        return F.when(n == 0, piece).otherwise(F.concat(F.lit(LINK_START), href, F.regexp_replace(piece, '^[^"]*', "")))

    html = F.array_join(F.transform(F.split("html", LINK_START), linked), "")
    address = F.concat(F.lit(f"{SITE}/pages/"), F.col("page_id").cast("string"))
    return pages(spark, sf_dir).select("page_id", address.alias("url"), html.alias("html"))


def ranked_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked listing for each page that has a title: its first word, language and number as a film."""
    name = representable(spark, F.regexp_extract("html", "<title>([^ <]+)", 1))
    entry = F.concat(
        F.lit('<dd>\n<i class="board-index">'), F.col("page_id"), F.lit('</i>\n<p class="name"><a href="#">'), name,
        F.lit('</a></p>\n<p class="star">'), F.regexp_extract("html", '<html lang="([^"]*)"', 1),
        F.lit('</p>\n<p class="releasetime">'), F.col("page_id") % 30 + 1990,
        F.lit('</p>\n<p class="score"><i class="integer">'), F.col("page_id") % 10,
        F.lit('.</i><i class="fraction">'), F.col("page_id") % 7, F.lit("</i></p>\n</dd>"),
    )
    return pages(spark, sf_dir).where(F.col("html").rlike("<title>[^ <]")).select("page_id", "url", entry.alias("html"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed instruments; screens and reports take no others."""
    return listed_instruments(listing(spark, sf_dir))


def listed(bars: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of listed instruments."""
    return bars.join(master(spark, sf_dir).select("symbol"), "symbol", "left_semi")


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly reports: one row per supplier and quarter of shipping."""
    rows = table(spark, sf_dir, "lineitem")
    quarter = F.trunc(F.col("l_shipdate").cast("date"), "quarter")
    sums = rows.groupBy(F.col("l_suppkey").alias("symbol"), quarter.alias("quarter")).agg(
        (F.count("*") / F.lit(10.0)).alias("eps"),
        (F.sum(F.col("l_quantity").cast(MONEY)).cast("double") / F.lit(100.0)).alias("capital_rese_ps"),
    )
    report_end = F.date_sub(F.add_months("quarter", 3), 1)
    return sums.select("symbol", report_end.alias("report_end"), "eps", "capital_rese_ps")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earnings forecasts: sign-up and purchase events."""
    day = F.col("ts").cast("date")
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("signup", "purchase"))
        .select(
            F.col("user_id").alias("symbol"),
            day.alias("ann_date"),
            F.last_day(day).alias("end_date"),
            F.col("event_type").alias("type"),
            (F.col("value") - 50).alias("p_change_min"),
            (F.col("value") + 50).alias("p_change_max"),
        )
    )


# Business types and names of the derived ledger, in the roles of the reports.
NOT_TRADES = ("NOT SPECIFIED",)
DEPOSIT = "1-URGENT"
WITHDRAWAL = "2-HIGH"
OPEN_POSITIONS = ("BUILDING", "MACHINERY")


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger entries in text, with unreadable amounts and dates among them."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    rows = lookup(orders, customers, ["custkey"], ["o_orderkey"], how="inner")
    price = F.col("o_totalprice").cast(MONEY)
    outflow = (F.col("o_orderpriority") == WITHDRAWAL) | (
        F.col("o_orderpriority").isin("3-MEDIUM", "5-LOW") & (F.col("o_orderstatus") == "O")
    )
    amount = F.when(outflow, -price).otherwise(price).cast(MONEY).cast("string")
    rate = {"fee": "0.001", "stamp_duty": "0.001", "transfer_fee": "0.0002"}
    return rows.select(
        F.year("o_orderdate").cast("string").alias("sheet"),
        F.when(F.col("o_orderkey") % 89 == 0, "n/a")
        .otherwise(F.date_format("o_orderdate", "yy/MM/dd"))
        .alias("trade_date"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("c_mktsegment")).alias("security"),
        F.col("o_orderpriority").alias("business"),
        F.when(F.col("o_orderkey") % 97 == 0, "--").otherwise(amount).alias("amount"),
        *[(price * F.lit(r).cast("decimal(5,4)")).cast("decimal(20,6)").cast("string").alias(n) for n, r in rate.items()],
        F.col("o_orderkey").cast("string").alias("contract_no"),
    )


