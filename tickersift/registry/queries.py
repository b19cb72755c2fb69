"""One registered query per operator or job, over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickersift.functions.charset import encode_text, representable
from tickersift.functions.dates import days_after, days_before, yyyymmdd
from tickersift.functions.scratch import scratch_path, staged
from tickersift.functions.text import first_match, pattern
from tickersift.operators.bars import (
    forward_adjusted,
    latest_averages,
    latest_rows,
    moving_averages,
    only_survivors,
    percent_change,
    resample,
)
from tickersift.operators.calendar import session_offsets, trading_calendar
from tickersift.operators.ledger import cash_flow, clean_ledger, cleared_profit, profit_list, ranked_profit
from tickersift.operators.pages import FILM_FIELDS, follow_links, page_first_match, page_index, page_links, page_records
from tickersift.operators.panel import NEIGHBOURS, listed_returns, neighbour_returns, offset_name, session_panel
from tickersift.operators.ranking import ranked
from tickersift.operators.stored import append_averages, bars_by_symbol, start_averages, stored_averages
from tickersift.plans import screens as s
from tickersift.plans.crawl import Site, by_url, chapter_texts, film_listing
from tickersift.plans.daily import daily_findings
from tickersift.plans.fundamentals import (
    HighTransfer,
    SmallCap,
    forecast_enrich,
    fundamentals_join,
    high_transfer,
    latest_reports,
    small_cap,
    snapshot_enrich,
)
from tickersift.registry import inputs
from tickersift.sinks.tables import (
    CSV_FORM,
    export_day,
    read_csv,
    read_text_by_title,
    write_by_date,
    write_csv,
    write_lines_by_title,
    write_page_folders,
    write_text_by_title,
)
from tickersift.sources.ledgers import read_sheet_folder, read_sheets
from tickersift.sources.market import between_dates, first_symbols, listed_instruments, read_table, snapshot
from tickersift.sources.pages import decode_pages, paged_urls, read_page_folders
from tickersift.sources.schemas import LEDGER_COLUMNS, conform

Query = Callable[[SparkSession, str], DataFrame]

SNAPSHOT_DAY = date(1997, 11, 17)
RANGE_START, RANGE_END = date(1995, 6, 5), date(1998, 12, 28)
REPORTS_START, REPORTS_END = date(1995, 3, 31), date(2001, 12, 31)
FORECASTS_START, FORECASTS_END = date(2024, 1, 10), date(2024, 12, 31)
HISTORY_START = date(1995, 1, 2)
SYMBOL_LIMIT = 4

NAV_LINK = pattern(r'<li><a href="(.*?)">(.*?)</a></li>')
NAV_TARGET = pattern(r'<li><a href="(.*?)">')
BOOK_LINK = pattern(r'<li><a href="(https://.*?)">(.*?)</a></li>')
ONWARD_LINK = pattern(r'<li><a href="(//.*?)">')
CHAPTER_LINK = pattern(r'<li><a href="(/pages/.*?)">(.*?)</a></li>')
TITLE_WORD = pattern(r"<title>([^ <]+)")
BODY = pattern(r"</script>(.*?)<footer>", across_lines=True)
RECORD = pattern(
    r'<html lang="(.*?)">.*?<title>(.*?)</title>.*?<h1>(.*?)</h1>.*?&copy; (.*?) &middot; (.*?)</footer>',
    across_lines=True,
)
RECORD_FIELDS = ("lang", "title", "heading", "host", "note")

# Screen bounds that fit the price and turnover ranges of the driver tables.
BOUNDS = {
    "steady_turnover": s.SteadyTurnover(15, 60, 10, 80, 5000, 80000),
    "valley_turnover": s.ValleyTurnover(20, 5, 5000, 90000, 5, 90, 5),
    "v_shape": s.VShape(-90, 300, 10),
    "rising_lows": s.RisingLows(400, 5000, 100000, 5, 5),
    "doji": s.Doji(0.05, -50, 400, -90, 500, True, ("NATION_1", "NATION_2"), 10, 5, 5, 90, 5),
    "cross_all_averages": s.CrossAllAverages(55000, 104000, 38, 90, 34, 20),
    "turnover_surge": s.TurnoverSurge(5000, 3),
}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison with another engine."""
    exact = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(exact) if exact else df


# --- scans -----------------------------------------------------------------------------


def scan_master(spark: SparkSession, sf: str) -> DataFrame:
    return listed_instruments(inputs.listing(spark, sf))


def scan_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    bars = inputs.with_metrics(inputs.weekly_bars(spark, sf, SNAPSHOT_DAY, SNAPSHOT_DAY))
    columns = ("symbol", "bar_date", "open", "high", "low", "close", "pe", "pe_ttm", "tor", "total_mv")
    return plain(snapshot(bars, SNAPSHOT_DAY, columns))


def bars_range(spark: SparkSession, sf: str) -> DataFrame:
    return plain(between_dates(inputs.weekly_bars(spark, sf, RANGE_START, RANGE_END), RANGE_START, RANGE_END))


def limit_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return first_symbols(listed_instruments(inputs.listing(spark, sf)), SYMBOL_LIMIT)


# --- bars ------------------------------------------------------------------------------


def bars_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return plain(resample(inputs.daily_bars(spark, sf), "week"))


def bars_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return plain(percent_change(resample(inputs.daily_bars(spark, sf), "month")))


def bars_pct_change(spark: SparkSession, sf: str) -> DataFrame:
    bars = percent_change(inputs.weekly_bars(spark, sf))
    return plain(bars.select("symbol", "bar_date", "close", "pre_close", "pct_chg"))


def bars_qfq(spark: SparkSession, sf: str) -> DataFrame:
    bars = forward_adjusted(inputs.with_factor(inputs.weekly_bars(spark, sf)))
    return plain(bars.select("symbol", "bar_date", "open", "high", "low", "close"))


def bars_qfq_monthly(spark: SparkSession, sf: str) -> DataFrame:
    daily = forward_adjusted(inputs.with_factor(inputs.daily_bars(spark, sf)))
    monthly = percent_change(resample(daily, "month"))
    return plain(monthly.select("symbol", "bar_date", "open", "high", "low", "close", "pct_chg"))


def moving_averages_all(spark: SparkSession, sf: str) -> DataFrame:
    bars = moving_averages(inputs.weekly_bars(spark, sf))
    return plain(bars.select("symbol", "bar_date", "close", *[f"ma{n}" for n in s.AVERAGES]))


def moving_averages_qfq(spark: SparkSession, sf: str) -> DataFrame:
    bars = moving_averages(inputs.with_factor(inputs.weekly_bars(spark, sf)))
    return plain(bars.select("symbol", "bar_date", "close", *[f"ma{n}" for n in s.AVERAGES]))


def latest_ma(spark: SparkSession, sf: str) -> DataFrame:
    found = latest_averages(inputs.with_factor(inputs.listed(inputs.weekly_bars(spark, sf), spark, sf)))
    return plain(found.select("symbol", "bar_date", "close", "low", *[f"ma{n}" for n in s.AVERAGES]))


def latest3_weekly(spark: SparkSession, sf: str) -> DataFrame:
    bars = latest_rows(resample(inputs.daily_bars(spark, sf), "week"), 3)
    return plain(bars.select("symbol", "bar_date", "open", "high", "low", "close", "age"))


# --- calendar and panel ----------------------------------------------------------------


def calendar_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = session_offsets(inputs.calendar(spark, sf))
    return rows.withColumns(
        {
            "day_before": yyyymmdd(days_before(F.col("bar_date"), 1)),
            "day_after": yyyymmdd(days_after(F.col("bar_date"), 1)),
        }
    )


def full_panel(spark: SparkSession, sf: str, averages=()) -> DataFrame:
    """The panel over adjusted bars. The bars are stored first, so that they and the calendar cost one scan of the trades."""
    bars = staged(inputs.weekly_bars(spark, sf), "bars")
    quoted = inputs.with_factor(inputs.with_metrics(percent_change(bars)))
    return session_panel(moving_averages(quoted, averages) if averages else quoted, trading_calendar(bars))


def panel_columns(spark: SparkSession, sf: str) -> DataFrame:
    wide = [f"{c}_b{k}" for c in ("tor", "high", "low") for k in range(1, 6)]
    today = ["symbol", "bar_date", "sess", "open", "high", "low", "close", "pre_close", "tor", "pct_chg"]
    return plain(full_panel(spark, sf).select(*today, *wide, "pct_b1", "pct_b2", "pct_n1"))


RETURNS = [offset_name("pct", k) for k in NEIGHBOURS]


def session_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Every bar of a listed stock with the changes of the sessions around it, for all sessions at once."""
    bars = percent_change(staged(inputs.listed(inputs.weekly_bars(spark, sf), spark, sf), "bars"))
    found = neighbour_returns(bars, inputs.calendar(spark, sf))
    return plain(found.select("symbol", "bar_date", "sess", "close", "pct_chg", *RETURNS))


def session_returns_day(spark: SparkSession, sf: str) -> DataFrame:
    """Every listed stock on one day, whether it traded or not, with the changes of the sessions around."""
    bars = inputs.quoted_bars(spark, sf)
    columns = ("close", "pe", "pe_ttm", "tor", "pct_chg")
    return plain(listed_returns(inputs.master(spark, sf), bars, staged(inputs.calendar(spark, sf), "calendar"), SNAPSHOT_DAY, columns))


def survivors(name: str, spark: SparkSession, sf: str) -> DataFrame:
    screen = s.DAILY[name]
    panel = full_panel(spark, sf, screen.averages).join(inputs.master(spark, sf), "symbol")
    return screen.survivors(panel, BOUNDS[name])


def screen_query(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return plain(s.report(survivors(name, spark, sf)))

    return run


def ma_survivors(spark: SparkSession, sf: str) -> DataFrame:
    bars = inputs.with_factor(inputs.listed(inputs.weekly_bars(spark, sf), spark, sf))
    today = snapshot(inputs.weekly_bars(spark, sf, SNAPSHOT_DAY, SNAPSHOT_DAY), SNAPSHOT_DAY)
    screened = s.keep(inputs.with_metrics(today), *s.within(F.col("pe"), 10, 60))
    found = latest_averages(only_survivors(bars, staged(screened, "screened")))
    return plain(found.select("symbol", "bar_date", "close", "low", *[f"ma{n}" for n in s.AVERAGES]))


def rank_by_next_return(spark: SparkSession, sf: str) -> DataFrame:
    rows = survivors("turnover_surge", spark, sf).select("symbol", "bar_date", "close", "pct_n1")
    order = [F.desc_nulls_last("pct_n1"), F.asc("symbol")]
    return plain(ranked(rows, order, by="bar_date").withColumn("rank", F.col("rank") - 1))


def bars_by_date(spark: SparkSession, sf: str) -> DataFrame:
    quoted = inputs.with_factor(inputs.quoted_bars(spark, sf))
    path = scratch_path(spark, "bars")
    write_by_date(quoted, path)
    return spark.read.schema(quoted.schema).parquet(path)


def daily_job(spark: SparkSession, sf: str) -> DataFrame:
    """All seven screens for one day over bars stored by date, as one ranked list of findings."""
    bars = bars_by_date(spark, sf)
    sessions = staged(trading_calendar(bars), "calendar")
    return plain(daily_findings(bars, sessions, inputs.master(spark, sf), SNAPSHOT_DAY, HISTORY_START, BOUNDS))


def daily_job_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same from averages that are kept by date: those up to a week before, then that week's added to them."""
    bars = bars_by_date(spark, sf)
    path = scratch_path(spark, "averages")
    start_averages(bars, path, SNAPSHOT_DAY - timedelta(days=7))
    append_averages(bars, path, SNAPSHOT_DAY)
    sessions = staged(trading_calendar(bars), "calendar")
    found = daily_findings(bars, sessions, inputs.master(spark, sf), SNAPSHOT_DAY, HISTORY_START, BOUNDS, stored_averages(spark, path))
    return plain(found)


def screens_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """All seven screens over all sessions in one pass over one bar table stored by symbol."""
    bars = bars_by_symbol(inputs.weekly_bars(spark, sf), scratch_path(spark, "bars-by-symbol"))
    quoted = inputs.with_factor(inputs.with_metrics(percent_change(bars)))
    panel = session_panel(moving_averages(quoted), trading_calendar(bars)).join(inputs.master(spark, sf), "symbol")
    return plain(s.report(s.all_survivors(panel, BOUNDS), "screen"))


# --- weekly and fundamental screens ----------------------------------------------------


def screen_weekly_rising(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.weekly_rising(inputs.listed(inputs.weekly_bars(spark, sf), spark, sf))
    return plain(rows.select("symbol", "bar_date", "open", "high", "low", "close"))


def screen_weekly_rising_qfq(spark: SparkSession, sf: str) -> DataFrame:
    """The same screen on weekly bars of adjusted daily prices."""
    weekly = resample(forward_adjusted(inputs.with_factor(inputs.listed(inputs.daily_bars(spark, sf), spark, sf))), "week")
    return plain(s.weekly_rising(weekly).select("symbol", "bar_date", "open", "high", "low", "close"))


def screen_weekly_rising_now(spark: SparkSession, sf: str) -> DataFrame:
    return plain(s.weekly_rising_now(inputs.listed(inputs.weekly_bars(spark, sf), spark, sf)))


def latest_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The newest quote of each instrument, enriched with its name and industry."""
    newest = inputs.with_metrics(latest_rows(inputs.weekly_bars(spark, sf)).drop("age"))
    return snapshot_enrich(inputs.master(spark, sf), newest)


def screen_high_transfer(spark: SparkSession, sf: str) -> DataFrame:
    bounds = HighTransfer(9000, 6, 2.5, 500, 150, 3000)
    path = scratch_path(spark, "indicators")
    inputs.indicators(spark, sf).write.parquet(path)
    saved = read_table(spark, path, ["symbol", "report_end", "capital_rese_ps", "eps"])
    rows = high_transfer(latest_quotes(spark, sf), saved, bounds)
    columns = ("symbol", "name", "close", "float_share", "total_share", "circ_mv", "total_mv")
    return plain(rows.select(*columns, "report_end", "capital_rese_ps", "eps"))


def screen_small_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Listed instruments with one day's metrics and that day's change."""
    day = staged(snapshot(inputs.quoted_bars(spark, sf, end=SNAPSHOT_DAY), SNAPSHOT_DAY), "quotes")
    metrics = day.select("symbol", "bar_date", "close", "pe", "float_share", "total_mv")
    rows = snapshot_enrich(inputs.master(spark, sf), metrics, day.select("symbol", "bar_date", "pct_chg"))
    columns = ("symbol", "name", "bar_date", "close", "pct_chg", "pe", "float_share", "total_mv")
    return plain(small_cap(rows, SmallCap(160, 1500, 45000, 8, 35)).select(*columns))


def snapshot_enriched(spark: SparkSession, sf: str) -> DataFrame:
    bars = staged(snapshot(inputs.weekly_bars(spark, sf, SNAPSHOT_DAY, SNAPSHOT_DAY), SNAPSHOT_DAY), "quotes")
    metrics = inputs.with_metrics(bars).select("symbol", "bar_date", "close", "pe", "pe_ttm", "tor")
    prices = bars.select("symbol", "bar_date", "open", "high", "low")
    return plain(snapshot_enrich(inputs.master(spark, sf), metrics, prices))


def fundamentals_joined(spark: SparkSession, sf: str) -> DataFrame:
    reports = between_dates(inputs.indicators(spark, sf), REPORTS_START, REPORTS_END, "report_end")
    quotes = latest_quotes(spark, sf).select("symbol", "name", "industry", "area", "bar_date", "close", "pe", "pe_ttm")
    return plain(fundamentals_join(reports, quotes))


def fundamentals_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The report join over a table that was downloaded three times, first with other values."""
    reports = between_dates(inputs.indicators(spark, sf), REPORTS_START, REPORTS_END, "report_end")
    passes = F.explode(F.array(*map(F.lit, (1, 2, 2)))).alias("pass")
    stale = F.when(F.col("pass") == 1, F.col("eps") - 1).otherwise(F.col("eps"))
    repeated = reports.select("*", passes).withColumn("eps", stale)
    quotes = latest_quotes(spark, sf).select("symbol", "name", "industry", "area", "bar_date", "close", "pe", "pe_ttm")
    return plain(fundamentals_join(latest_reports(repeated, "pass"), quotes))


def forecast_enriched(spark: SparkSession, sf: str) -> DataFrame:
    rows = between_dates(inputs.forecasts(spark, sf), FORECASTS_START, FORECASTS_END, "ann_date")
    quotes = latest_quotes(spark, sf).select("symbol", "name", "industry", "area", "bar_date", "close", "pe", "pe_ttm")
    return plain(forecast_enrich(rows, quotes))


# --- ledger ----------------------------------------------------------------------------


def ledger_union(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets written as CSV in two layouts, then read back and appended."""
    raw = inputs.raw_ledger(spark, sf)
    path = scratch_path(spark, "ledger")
    old, new = raw.where("sheet < '1998'"), raw.where("sheet >= '1998'")
    write_csv(old.drop("sheet"), f"{path}/early")
    write_csv(new.select("contract_no", "fee", "amount", "business", "security", "trade_date"), f"{path}/late")
    sheets = read_sheets(spark, {"early": f"{path}/early", "late": f"{path}/late"})
    return conform(sheets, ("sheet", "trade_date", "security", "business", "amount", "fee", "transfer_fee", "contract_no"))


def ledger_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet for each year, in two layouts below one folder, read back in one scan per layout."""
    raw = inputs.raw_ledger(spark, sf)
    path = scratch_path(spark, "sheets")
    kept = ("contract_no", "fee", "amount", "business", "security", "trade_date")
    for name, rows in (("early", raw.where("sheet < '1995'")), ("late", raw.where("sheet >= '1995'").select("sheet", *kept))):
        rows.repartition("sheet").write.options(**CSV_FORM).partitionBy("sheet").csv(f"{path}/{name}")
    return conform(read_sheet_folder(spark, path), ("sheet", "trade_date", "security", "business", "amount", "fee", "transfer_fee", "contract_no"))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_ledger(inputs.raw_ledger(spark, sf), inputs.NOT_TRADES)


def ledger_clean(spark: SparkSession, sf: str) -> DataFrame:
    return plain(clean(spark, sf).select(*LEDGER_COLUMNS))


def ledger_profit(spark: SparkSession, sf: str) -> DataFrame:
    return plain(ranked_profit(profit_list(clean(spark, sf))))


def ledger_cashflow(spark: SparkSession, sf: str) -> DataFrame:
    return plain(cash_flow(clean(spark, sf), inputs.DEPOSIT, inputs.WITHDRAWAL))


def ledger_cleared_profit(spark: SparkSession, sf: str) -> DataFrame:
    return plain(cleared_profit(profit_list(clean(spark, sf)), inputs.OPEN_POSITIONS))


# --- pages -----------------------------------------------------------------------------


pages = inputs.pages


def links(spark: SparkSession, sf: str) -> DataFrame:
    return page_links(pages(spark, sf), NAV_LINK)


def title_word(html: str = "html"):
    return first_match(F.col(html), TITLE_WORD)


def first_link(spark: SparkSession, sf: str) -> DataFrame:
    return page_first_match(pages(spark, sf), NAV_TARGET, "href")


def body(spark: SparkSession, sf: str) -> DataFrame:
    return page_first_match(pages(spark, sf), BODY, "body")


def records(spark: SparkSession, sf: str) -> DataFrame:
    return page_records(pages(spark, sf), RECORD, RECORD_FIELDS)


def link_follow(spark: SparkSession, sf: str) -> DataFrame:
    """Links of every page, resolved against its address and followed to the page they name."""
    site = inputs.site(spark, sf)
    found = page_links(site, NAV_LINK, keep=("page_id", "url"))
    followed = follow_links(found, page_index(site, F.col("url")), by_url(F.col("url"), F.col("href")), ["page_id", "pos"])
    return followed.select("page_id", "pos", "href", "title", "target_id")


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a book list: its absolute links are books, a book's link by host leads to its chapters."""
    site = Site(BOOK_LINK, ("href", "title"), ONWARD_LINK, CHAPTER_LINK, ("href", "title"), BODY)
    table = inputs.site(spark, sf)
    return chapter_texts(table, table, site)


def page_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return paged_urls(pages(spark, sf).select("page_id", "url")).select("page_id", "offset", "page_url")


def pages_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as GBK bytes, decoded again; what GBK cannot hold has become '?'."""
    raw = pages(spark, sf).select("page_id", encode_text(spark, F.col("html")).alias("content"))
    return decode_pages(raw)


def page_files_gbk(spark: SparkSession, sf: str) -> DataFrame:
    """Pages stored as one GBK file each, every third with bytes that are no GBK, and read back."""
    flat = F.regexp_replace("html", r"[\r\n]", " ")
    broken = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    raw = pages(spark, sf).select("page_id", F.concat(encode_text(spark, flat), broken).alias("content"))
    path = scratch_path(spark, "page-files")
    write_page_folders(raw, path)
    read = read_page_folders(spark, path)
    return read.select(F.regexp_extract("url", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"), "html")


def paged_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-part listings end to end: addresses by offset, the stored pages they name, their records as GBK text."""
    number = F.col("page_id")
    base = F.concat(F.lit("https://films.example/board/"), F.floor(number / 10).cast("string"))
    stored = inputs.ranked_listings(spark, sf).select(
        F.concat(base, F.lit("?offset="), (number % 10 * 10).cast("string")).alias("page_url"), "page_id", "html"
    )
    starts = pages(spark, sf).select(base.alias("url")).distinct()
    path = scratch_path(spark, "films")
    film_listing(paged_urls(starts).join(stored, "page_url"), path)
    return read_csv(spark, path, ", ".join(f"{c} string" for c in FILM_FIELDS), "GBK")


# --- sinks -----------------------------------------------------------------------------


def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    bars = inputs.weekly_bars(spark, sf)
    path = scratch_path(spark, "bars")
    write_by_date(bars, path)
    return plain(spark.read.schema(bars.schema).parquet(path))


def sink_dated_export(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of three days, one of them run again after a first run with other prices, read back."""
    path = scratch_path(spark, "reports")
    bars = staged(inputs.weekly_bars(spark, sf), "bars")
    report = bars.select("symbol", "bar_date", "close", "vol")
    days = [SNAPSHOT_DAY + timedelta(days=7 * k) for k in range(3)]
    export_day(snapshot(report, days[1]).withColumn("close", (F.col("close") + 1).cast(report.schema["close"].dataType)), path, days[1])
    for day in days:
        export_day(snapshot(report, day), path, day)
    schema = T.StructType([*report.schema.fields, T.StructField("report_date", T.DateType())])
    return plain(spark.read.schema(schema).parquet(path))


def sink_csv_gbk(spark: SparkSession, sf: str) -> DataFrame:
    """Listing records appended as GBK text in two runs, then read back."""
    found = records(spark, sf)
    rows = staged(found.select("page_id", *[representable(spark, F.col(c)).alias(c) for c in RECORD_FIELDS]), "found")
    path = scratch_path(spark, "records")
    write_csv(rows.where(F.col("lang") == "en"), path, "append", "GBK")
    write_csv(rows.where(F.col("lang") != "en"), path, "append", "GBK")
    return read_csv(spark, path, rows.schema, "GBK", line_breaks=True)


def film_records(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked listings, one per page, extracted and appended as GBK text in two runs, then read back."""
    listings = inputs.ranked_listings(spark, sf)
    path = scratch_path(spark, "films")
    for odd in (0, 1):
        film_listing(listings.where(F.pmod("page_id", F.lit(2)) == odd), path)
    return read_csv(spark, path, ", ".join(f"{c} string" for c in FILM_FIELDS), "GBK")


def sink_text_by_title(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "texts")
    write_text_by_title(pages(spark, sf).select(title_word().alias("title"), first_match(F.col("html"), BODY).alias("text")), path)
    return read_text_by_title(spark, path).select("title", F.col("value").alias("line"))


def sink_lines_by_title(spark: SparkSession, sf: str) -> DataFrame:
    """Page texts by title with the place of every line, equal titles kept apart, read back from one sorted table."""
    path = scratch_path(spark, "lines")
    texts = pages(spark, sf).select("page_id", title_word().alias("title"), first_match(F.col("html"), BODY).alias("text"))
    write_lines_by_title(texts, path, part="page_id")
    return spark.read.parquet(path).withColumnRenamed("part", "page_id")


QUERIES: dict[str, Query] = {
    "scan_master": scan_master,
    "scan_snapshot": scan_snapshot,
    "bars_range": bars_range,
    "limit_symbols": limit_symbols,
    "bars_weekly": bars_weekly,
    "bars_monthly": bars_monthly,
    "bars_pct_change": bars_pct_change,
    "bars_qfq": bars_qfq,
    "bars_qfq_monthly": bars_qfq_monthly,
    "moving_averages": moving_averages_all,
    "moving_averages_qfq": moving_averages_qfq,
    "latest_ma": latest_ma,
    "latest3_weekly": latest3_weekly,
    "calendar_sessions": calendar_sessions,
    "session_panel": panel_columns,
    "session_returns": session_returns,
    "session_returns_day": session_returns_day,
    "ma_survivors": ma_survivors,
    "rank_by_next_return": rank_by_next_return,
    "screen_steady_turnover": screen_query("steady_turnover"),
    "screen_valley_turnover": screen_query("valley_turnover"),
    "screen_v_shape": screen_query("v_shape"),
    "screen_rising_lows": screen_query("rising_lows"),
    "screen_doji": screen_query("doji"),
    "screen_cross_all_ma": screen_query("cross_all_averages"),
    "screen_turnover_surge": screen_query("turnover_surge"),
    "daily_screens": daily_job,
    "daily_screens_stored": daily_job_stored,
    "screens_by_symbol": screens_by_symbol,
    "screen_weekly_rising": screen_weekly_rising,
    "screen_weekly_rising_qfq": screen_weekly_rising_qfq,
    "screen_weekly_rising_now": screen_weekly_rising_now,
    "screen_high_transfer": screen_high_transfer,
    "screen_small_cap": screen_small_cap,
    "snapshot_enrich": snapshot_enriched,
    "fundamentals_join": fundamentals_joined,
    "fundamentals_latest": fundamentals_latest,
    "forecast_enrich": forecast_enriched,
    "ledger_union": ledger_union,
    "ledger_sheets": ledger_sheets,
    "ledger_clean": ledger_clean,
    "ledger_profit": ledger_profit,
    "ledger_cashflow": ledger_cashflow,
    "ledger_cleared_profit": ledger_cleared_profit,
    "page_links": links,
    "page_first_match": first_link,
    "page_body": body,
    "page_records": records,
    "page_link_follow": link_follow,
    "page_chapters": chapters,
    "page_offsets": page_offsets,
    "pages_decode": pages_decode,
    "page_files_gbk": page_files_gbk,
    "paged_listing": paged_listing,
    "sink_roundtrip": sink_roundtrip,
    "sink_dated_export": sink_dated_export,
    "sink_csv_gbk": sink_csv_gbk,
    "film_records": film_records,
    "sink_text_by_title": sink_text_by_title,
    "sink_lines_by_title": sink_lines_by_title,
}
