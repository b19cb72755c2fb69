from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickersift.functions.dates import lenient_short_date
from tickersift.functions.numeric import body_ratio, grew_by, keep, lenient_decimal, nan_to_null, never_rising, within
from tickersift.functions.scratch import scratch_path, staged
from tickersift.functions.text import contains_none, explode_matches, first_match, pattern


def one(spark, schema, rows, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("69/1/2", date(1969, 1, 2)),
        ("68/1/2", date(2068, 1, 2)),
        ("99/12/31", date(1999, 12, 31)),
        ("00/2/29", date(2000, 2, 29)),
        ("19/8/8", date(2019, 8, 8)),
        ("19/08/08", date(2019, 8, 8)),
        ("19/2/30", None),
        ("2019/8/8", None),
        ("bad", None),
        ("", None),
        (None, None),
    ],
)
def test_short_dates(spark, text, expected):
    assert one(spark, "t string", [(text,)], d=lenient_short_date(F.col("t")))[0]["d"] == expected


@pytest.mark.parametrize(
    "text,expected",
    [("12.5", Decimal("12.5")), (" -3 ", Decimal("-3")), ("--", None), ("1,200", None), ("", None), (None, None)],
)
def test_lenient_numbers(spark, text, expected):
    assert one(spark, "t string", [(text,)], n=lenient_decimal(F.col("t")))[0]["n"] == expected


def test_nan_becomes_null_and_fails_filters(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, None)], "id int, pe double")
    assert df.where("pe >= 3").count() == 2  # NaN passes in Spark
    assert [r.id for r in nan_to_null(df).where("pe >= 3").collect()] == [2]


@pytest.mark.parametrize(
    "now,before,expected", [(6.0, 2.0, True), (5.9, 2.0, False), (1.0, 0.0, True), (0.0, 0.0, None), (None, 1.0, None)]
)
def test_growth_from_zero(spark, now, before, expected):
    got = one(spark, "a double, b double", [(now, before)], g=grew_by(F.col("a"), F.col("b"), 3))[0]["g"]
    assert bool(got) == bool(expected)


def test_body_ratio_of_zero_open_is_unknown(spark):
    assert one(spark, "o double, c double", [(0.0, 1.0)], r=body_ratio(F.col("o"), F.col("c")))[0]["r"] is None


def test_never_rising_allows_ties(spark):
    got = one(spark, "x int, y int, z int", [(3, 3, 2), (3, 4, 2)], m=never_rising(*map(F.col, "xyz")))
    assert [r["m"] for r in got] == [True, False]


def test_open_ended_bounds(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "x int")
    assert [r.x for r in keep(df, *within(F.col("x"), 5)).collect()] == [5, 9]
    assert [r.x for r in keep(df, *within(F.col("x"), 2, 8)).collect()] == [5]


def test_negated_match_drops_null_text(spark):
    df = spark.createDataFrame([("buy",), ("申购配号",), (None,)], "t string")
    assert [r.t for r in df.where(contains_none(F.col("t"), ("申购配号", "保证金"))).collect()] == ["buy"]


def test_first_match_tells_empty_from_absent(spark):
    rows = [("<t></t>",), ("<t>a</t><t>b</t>",), ("none",), (None,)]
    got = one(spark, "h string", rows, m=first_match(F.col("h"), pattern("<t>(.*?)</t>")))
    assert [r["m"] for r in got] == ["", "a", None, None]


def test_lines_end_at_line_feed_only(spark):
    rows = [("<t>a\rb</t>",), ("<t>a\nb</t>",)]
    inside = one(spark, "h string", rows, m=first_match(F.col("h"), pattern("<t>(.*?)</t>")))
    across = one(spark, "h string", rows, m=first_match(F.col("h"), pattern("<t>(.*?)</t>", across_lines=True)))
    assert [r["m"] for r in inside] == ["a\rb", None]
    assert [r["m"] for r in across] == ["a\rb", "a\nb"]


def test_explode_matches_equals_findall(spark):
    import re

    html = '<a x="1">one</a>\n<a x="">two</a><a x="3"></a>'
    regex = r'<a x="(.*?)">(.*?)</a>'
    df = spark.createDataFrame([(7, html), (8, "none")], "id int, html string")
    got = explode_matches(df, "html", pattern(regex), ("x", "t"), ["id"]).orderBy("id", "pos").collect()
    assert [(r.x, r.t) for r in got] == re.findall(regex, html)
    assert {r.id for r in got} == {7}


def test_staged_table_is_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared + "/x-")
    df = staged(spark.range(5).withColumn("v", F.rand()), "rows")
    assert df.collect() == df.collect()
    assert all(shared in f for f in df.inputFiles())


def test_large_amounts_and_small_digits_survive(spark):
    text = "1234567890123456.1234567891"
    assert str(one(spark, "t string", [(text,)], n=lenient_decimal(F.col("t")))[0]["n"]) == text
