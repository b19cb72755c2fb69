from datetime import date

import pytest
from pyspark.sql import functions as F

from tickersift.functions.charset import representable
from tickersift.operators.pages import (
    CHAPTER_TEXT,
    RANKED_FILM,
    FILM_FIELDS,
    follow_links,
    page_first_match,
    page_index,
    page_links,
    page_records,
    resolve_url,
)
from tickersift.plans.crawl import chapter_texts, film_listing
from tickersift.sinks.tables import (
    dated,
    read_csv,
    read_lines_of_title,
    read_text_by_title,
    write_by_date,
    write_csv,
    write_lines_by_title,
    write_text_by_title,
)
from tickersift.sources.pages import paged_urls, read_page_files

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "base,href,expected",
    [
        ("http://h.com/a/b.html", "c.html", "http://h.com/a/c.html"),
        ("http://h.com/a/b.html?x=/1", "c.html", "http://h.com/a/c.html"),
        ("http://h.com/a/b.html", "/c", "http://h.com/c"),
        ("http://h.com", "c", "http://h.com/c"),
        ("https://h.com/a/", "//k.org/z", "https://k.org/z"),
        ("http://h.com/a/", "https://k.org/z", "https://k.org/z"),
        ("http://h.com/a/", None, None),
    ],
)
def test_resolve_url(spark, base, href, expected):
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(resolve_url(F.col("b"), F.col("h")).alias("u")).first().u == expected


def film(rank, name):
    return (
        f'<dd>\n<i class="board-index board-index-{rank}">{rank}</i>\n<p class="name"><a href="/f">{name}</a></p>\n'
        f'<p class="star">A,B</p>\n<p class="releasetime">1993</p>\n<p class="score"><i class="integer">9.</i>'
        f'<i class="fraction">{rank}</i></p></dd>'
    )


def test_film_records_append_as_gbk(spark, tmp_path):
    path = str(tmp_path / "films")
    for k in (1, 2):
        pages = spark.createDataFrame([(k, "u", "<dl>" + film(2 * k - 1, "霸王,别姬") + film(2 * k, 'X "Y"') + "</dl>")], PAGES)
        assert page_records(pages, RANKED_FILM, FILM_FIELDS).count() == 2
        film_listing(pages, path)
    schema = ", ".join(f"`{c}` string" for c in FILM_FIELDS)
    rows = sorted(tuple(r) for r in read_csv(spark, path, schema, "GBK").collect())
    assert rows == [
        (str(i), "霸王,别姬" if i % 2 else 'X "Y"', "A,B", "1993", "9.", str(i)) for i in (1, 2, 3, 4)
    ]
    raw = b"".join(f.read_bytes() for f in (tmp_path / "films").glob("*.csv"))
    assert "霸王".encode("gbk") in raw


def site(spark):
    listing = (
        '<a target="_blank" title="Book A" href="http://x.com/a.html" class="clearfix stitle">'
        '<a target="_blank" title="Book B" href="/b.html" class="clearfix stitle">'
        '<a target="_blank" title="Gone" href="/gone.html" class="clearfix stitle">'
    )
    book = '<a href="/{0}/index.html"  class="l mr11"><a href="/other.html"  class="l mr11">'
    chapter = "style5();</script>line 1 of {0}\nline 2<script type=\"text/javascript\">x"
    pages = [
        (1, "http://x.com/list.html", listing),
        (2, "http://x.com/a.html", book.format("a")),
        (3, "http://x.com/b.html", book.format("b")),
        (4, "http://x.com/a/index.html", '<li><a href="1.html" title="t">One</a></li><li><a href="2.html" title="t">Two</a></li>'),
        (5, "http://x.com/b/index.html", '<li><a href="1.html" title="t">Only</a></li>'),
        (6, "http://x.com/a/1.html", chapter.format("a1")),
        (7, "http://x.com/a/2.html", chapter.format("a2")),
        (8, "http://x.com/b/1.html", chapter.format("b1")),
        (9, "http://x.com/b/1.html", "a later copy"),
    ]
    return spark.createDataFrame(pages, PAGES)


def test_books_down_to_chapters(spark):
    pages = site(spark)
    start = spark.createDataFrame([(1,)], "page_id long")
    rows = chapter_texts(pages, start).orderBy("book_pos", "chapter_pos").collect()
    assert [(r.book, r.chapter, r.text) for r in rows] == [
        ("Book A", "One", "line 1 of a1\nline 2"),
        ("Book A", "Two", "line 1 of a2\nline 2"),
        ("Book B", "Only", "line 1 of b1\nline 2"),
    ]


def test_page_without_a_match(spark):
    rows = page_first_match(site(spark), CHAPTER_TEXT, "text").orderBy("page_id").collect()
    assert rows[0].text is None and rows[5].text == "line 1 of a1\nline 2"
    assert page_links(site(spark).where("page_id > 5"), "<li>(.*?)</li>", ("x",)).count() == 0


def test_index_takes_the_smallest_page(spark):
    index = page_index(site(spark), F.col("url"))
    assert index.where("address = 'http://x.com/b/1.html'").first().target_id == 8
    links = spark.createDataFrame([(1, 0, "http://x.com/b/1.html"), (1, 1, "nowhere"), (2, 0, None)], "page_id long, pos int, href string")
    assert [r.target_id for r in follow_links(links, index, F.col("href"), ["page_id", "pos"]).collect()] == [8]


def test_page_files_in_gbk(spark, tmp_path):
    (tmp_path / "1.html").write_bytes("<p>小说</p>".encode("gbk"))
    (tmp_path / "2.html").write_bytes(b"<p>\xff\xff broken</p>")
    rows = {r.url[-6:]: r.html for r in read_page_files(spark, str(tmp_path)).collect()}
    assert rows["1.html"] == "<p>小说</p>"
    assert rows["2.html"].endswith(" broken</p>")


def test_paged_urls(spark):
    df = spark.createDataFrame([("http://x.com/board/4?offset=3#t",)], "url string")
    rows = paged_urls(df).orderBy("offset").collect()
    assert [r.page_url for r in rows] == [f"http://x.com/board/4?offset={10 * i}" for i in range(10)]


def test_overwrite_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1), ("b", date(2020, 1, 2), 2)], "symbol string, bar_date date, v int")
    write_by_date(df, path)
    write_by_date(df.where("v = 2"), path)
    rows = spark.read.schema(df.schema).parquet(path).collect()
    assert [(r.symbol, r.bar_date, r.v) for r in rows] == [("b", date(2020, 1, 2), 2)]
    assert [p.name for p in (tmp_path / "t").glob("bar_date=*")] == ["bar_date=2020-01-02"]


def test_a_hot_date_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(0, 200_000, 1, 4).select(
        F.xxhash64("id").alias("v"), F.when(F.col("id") % 3 == 0, "2020-01-02").otherwise("2020-01-01").alias("bar_date")
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(size)
    spark.conf.set(size, "200k")
    try:
        write_by_date(df, str(tmp_path / "t"))
    finally:
        spark.conf.set(size, old)
    assert len(list((tmp_path / "t" / "bar_date=2020-01-01").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_dated_path():
    assert dated("out/report", date(2019, 8, 13)) == "out/report_20190813"


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, tmp_path):
    values = [" a ", 'say "hi", b', "two\nlines", "back\\slash"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    path = str(tmp_path / "c")
    write_csv(df, path, encoding="GBK")
    rows = read_csv(spark, path, df.schema, "GBK", line_breaks=True).orderBy("i").collect()
    assert [r.v for r in rows] == values


def test_unencodable_text_fails_the_job(spark, tmp_path):
    rows = spark.createDataFrame([("a\u00f4b",)], "t string")
    with pytest.raises(Exception, match="cannot hold"):
        write_csv(rows, str(tmp_path / "strict"), encoding="GBK")
    write_csv(rows.select(representable(spark, F.col("t")).alias("t")), str(tmp_path / "lossy"), encoding="GBK")
    assert read_csv(spark, str(tmp_path / "lossy"), "t string", "GBK").first().t == "a?b"


def test_text_by_title(spark, tmp_path):
    df = spark.createDataFrame([("a/b: c", "x\ny"), ("1997", "z"), (None, "n")], "title string, text string")
    path = str(tmp_path / "texts")
    write_text_by_title(df, path)
    rows = sorted((r.title or "", r.value) for r in read_text_by_title(spark, path).collect())
    assert rows == [("", "n"), ("1997", "z"), ("a/b: c", "x"), ("a/b: c", "y")]


def test_lines_by_title_keep_their_order_and_texts_apart(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(300))
    rows = [("a", 2, long), ("b", 1, "x\n\ny\n"), ("a", 1, "first\ntext"), (None, 1, "n"), ("c", 1, None), ("d", 1, "")]
    path = str(tmp_path / "lines")
    write_lines_by_title(spark.createDataFrame(rows, "title string, part long, text string").repartition(3), path)

    def texts(title):
        found = {}
        for r in read_lines_of_title(spark, path, title).collect():
            found.setdefault(r.part, []).append(r.line)
        return {part: "\n".join(lines) for part, lines in found.items()}

    assert texts("a") == {1: "first\ntext", 2: long} and texts("b") == {1: "x\n\ny\n"}
    assert texts(None) == {1: "n"} and texts("c") == {} and texts("d") == {1: ""}
    plan = read_lines_of_title(spark, path, "a")._jdf.queryExecution().toString()
    assert "EqualTo(title,a)" in plan or "EqualNullSafe(title,a)" in plan
    for title in "ab":  # in the files too, lines stand in their order
        stored = [r.position for r in spark.read.parquet(path).where(F.col("title") == title).where("part = 1").collect()]
        assert stored == sorted(stored)


def test_lines_of_no_texts(spark, tmp_path):
    write_lines_by_title(spark.createDataFrame([], "title string, part long, text string"), str(tmp_path / "none"))
    assert read_lines_of_title(spark, str(tmp_path / "none"), "a").count() == 0
