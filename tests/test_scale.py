"""Hot keys are split, plans push down, and nothing runs in Python or as a cross join."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tickersift.operators.joins import SALTS, lookup, lookup_wide
from tickersift.operators.ranking import ranked
from tickersift.registry import inputs
from tickersift.registry.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_adaptive(spark):
    """Fixed shuffle partitions and shuffle joins, so that the spread of rows is visible."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_rows(spark, n=4000):
    """Half of the rows share one key."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_plain_join(spark, how):
    left = hot_rows(spark).unionByName(spark.createDataFrame([(-1, None)], "id long, k long"))
    right = spark.range(0, 3000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup(left, right, ["k"], ["id"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_lookup_wide_equals_plain_join(spark):
    left, right = hot_rows(spark), spark.range(0, 3000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup_wide(left, right, ["k"], ["id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k"]).collect()))


@pytest.mark.parametrize("join", [lookup, lookup_wide])
def test_a_hot_key_is_spread_over_tasks(spark, no_adaptive, join):
    right = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = join(hot_rows(spark), right, ["k"], ["id"])
    hot = joined.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) >= 4
    assert max(r["count"] for r in hot) < 2000 * 0.6
    assert SALTS >= 8


def test_ranks_equal_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(3000).select(  # one large group, and one without a name
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 13 != 0, F.col("id") % 7).alias("g"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 11).alias("v"),
        "id",
    )
    order = [F.desc_nulls_last("v"), F.asc("id")]
    got = ranked(df, order, by="g")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    whole = {r.id: r["rank"] for r in ranked(df, order).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.v is None, -(r.v or 0), r.id))
    assert [whole[r.id] for r in rows] == list(range(1, 3001))


def test_one_big_group_is_ranked_by_many_tasks(spark, no_adaptive):
    df = spark.range(4000).select(F.lit("2020-01-06").alias("g"), F.lit(1.0).alias("v"), "id")
    rows = ranked(df, [F.desc("v"), F.asc("id")], by="g")
    files = {r[0] for r in rows.select(F.shiftright(F.col("rank"), 9)).distinct().collect()}
    assert len(files) == 8
    assert rows.rdd.getNumPartitions() > 1


def test_rank_of_an_empty_table(spark):
    assert ranked(spark.range(0), [F.asc("id")]).collect() == []


def test_scan_is_pruned_and_bounded(spark):
    text = plan(QUERIES["bars_range"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdate" in text
    assert "l_returnflag" not in text and "l_tax" not in text


def test_calendar_reads_one_column(spark):
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan(inputs.calendar(spark, SF))


def test_stored_bars_push_the_date_range_down(spark, tmp_path):
    from tickersift.sinks.tables import write_by_date
    from tickersift.sources.market import between_dates, snapshot

    path = str(tmp_path / "bars")
    write_by_date(inputs.weekly_bars(spark, SF), path)
    bars = spark.read.parquet(path)
    assert re.search(r"PartitionFilters: \[[^\]]*bar_date", plan(between_dates(bars, date(1996, 1, 1), date(1996, 2, 1))))
    assert len(snapshot(bars, date(1996, 1, 1)).inputFiles()) >= 1


def test_panel_shuffles_bars_once_after_their_aggregate(spark):
    """One exchange by (symbol, session) of partial bars, one by symbol for all windows."""
    bars = inputs.quoted_bars(spark, SF)
    from tickersift.operators.bars import moving_averages
    from tickersift.operators.panel import session_panel

    df = session_panel(moving_averages(bars), inputs.calendar(spark, SF))
    text = plan(df)
    assert text.count("Exchange hashpartitioning(symbol") == 2


def test_partial_aggregates_run_before_the_shuffle(spark, no_adaptive):
    """Trades shrink before they travel."""
    from tickersift.functions.dates import week_start
    from tickersift.operators.bars import bars_from_trades

    trades = spark.createDataFrame([("a", 1, 1.0, 1.0)], "symbol string, seq int, price double, qty double")
    trades = trades.withColumn("ts", F.current_timestamp())
    lines = plan(bars_from_trades(trades, week_start(F.col("ts")), ("ts", "seq"))).splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert any("partial_min" in line for line in lines[exchange:])


def test_newest_rows_are_cut_before_the_shuffle(spark):
    from tickersift.operators.bars import latest_averages

    bars = spark.createDataFrame([("a", date(2020, 1, 1), 1.0, 1.0)], "symbol string, bar_date date, close double, low double")
    assert "WindowGroupLimit" in plan(latest_averages(bars))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_workers_and_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize("name", ["session_panel", "screen_v_shape", "screen_small_cap", "snapshot_enrich"])
def test_trades_are_scanned_once(spark, name, monkeypatch):
    """By the query and all the tables it stores on the way."""
    from pyspark.sql import DataFrame

    from tickersift.functions import scratch
    from tickersift.registry import queries

    plans = []

    def staged(df: DataFrame, label: str) -> DataFrame:
        plans.append(plan(df))
        return scratch.staged(df, label)

    monkeypatch.setattr(queries, "staged", staged)
    plans.append(plan(QUERIES[name](spark, SF)))
    assert sum(len(re.findall(r"FileScan parquet [^\n]*l_shipdate", p)) for p in plans) == 1


def test_the_day_is_read_by_partition(spark, tmp_path):
    from tickersift.sinks.tables import write_by_date
    from tickersift.sources.market import between_dates

    quoted = inputs.with_factor(inputs.quoted_bars(spark, SF))
    write_by_date(quoted, str(tmp_path / "bars"))
    bars = spark.read.schema(quoted.schema).parquet(str(tmp_path / "bars"))
    assert re.search(r"PartitionFilters: \[[^\]]*bar_date", plan(between_dates(bars, date(1996, 1, 1), date(1996, 2, 1))))
