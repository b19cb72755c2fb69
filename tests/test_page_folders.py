"""Page files, many to a folder: written without a process or a folder for each, read by few tasks."""

import os

import pytest
from pyspark.sql import functions as F

from tickersift.functions.scratch import mounted_path
from tickersift.registry.queries import QUERIES
from tickersift.sinks import tables
from tickersift.sinks.tables import write_page_folders
from tickersift.sources import pages
from tickersift.sources.pages import packed_page_files, read_page_folders

SCHEMA = "page_id long, content binary"


def files_below(path):
    return {f"{os.path.relpath(d, path)}/{x}": open(f"{d}/{x}", "rb").read() for d, _, names in os.walk(path) for x in names}


def test_the_query_puts_many_page_files_into_a_folder_and_a_task(spark, tmp_path):
    texts = {i: f"<p>\u4e2d\u6587 {i}</p>\n\u00f4\r{'x' * i}" for i in range(300)}
    rows = spark.createDataFrame([(i, f"u{i}", t) for i, t in texts.items()], "page_id long, url string, html string")
    rows.repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    found = QUERIES["page_files_gbk"](spark, str(tmp_path))
    (folder,) = {x for x in os.listdir(shared) if x.startswith("page-files-")} - before
    stored = os.listdir(f"{shared}/{folder}")
    files = files_below(f"{shared}/{folder}")
    assert len(files) == 300 and len(stored) <= 4  # before: 300 folders
    size = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(size)
    spark.conf.set(size, "16m")
    try:
        assert found.rdd.getNumPartitions() <= 4  # before: 75, of 4 files each
    finally:
        spark.conf.set(size, old)
    flat = {i: t.replace("\n", " ").replace("\r", " ").replace("\u00f4", "?") + "\ufffd" * (i % 3 == 0) for i, t in texts.items()}
    assert {r.page_id: r.html for r in found.collect()} == flat and found.count() == 300


def test_page_folders_keep_every_byte_and_row(spark, tmp_path, monkeypatch):
    every = bytes(b for b in range(256) if b not in b"\r\n")
    rows = [(i, bytearray(b"%d " % i + every)) for i in range(25)] + [(7, bytearray(b"again")), (30, None), (31, bytearray()), (None, bytearray(b"none"))]
    path = str(tmp_path / "pages")
    write_page_folders(spark.createDataFrame(rows, SCHEMA).repartition(3, F.col("page_id")), f"file://{path}", pages=4)
    found = files_below(path)
    names = {f"page_id={i}.csv": b"%d " % i + every + b"\n" for i in range(25)} | {"page_id=__HIVE_DEFAULT_PARTITION__.csv": b"none\n"}
    got = {x.split("/")[-1]: c for x, c in found.items()}
    assert sorted(got.pop("page_id=7.csv").split(b"\n")) == sorted(names.pop("page_id=7.csv").split(b"\n") + [b"again"])
    assert got == names and len(found) == 26
    held = [len(os.listdir(f"{path}/{d}")) for d in os.listdir(path)]
    assert max(held) <= 4
    monkeypatch.setattr(pages, "BATCH_BYTES", 600)
    read = read_page_folders(spark, f"file://{path}", "ISO-8859-1")
    assert read.rdd.getNumPartitions() == len(held)
    packed = packed_page_files(spark, path, "ISO-8859-1", "*.csv")
    assert sorted(read.collect()) == sorted(packed.collect()) and read.dtypes == packed.dtypes and read.count() == 26
    html = {r.url.split("page_id=")[1]: r.html for r in read.collect()}
    assert html["3.csv"] == (b"3 " + every).decode("latin-1")


def test_names_are_encoded_and_folders_never_mix(spark, tmp_path):
    rows = spark.createDataFrame([("a/b c", bytearray(b"1")), ("..", bytearray(b"2"))], "title string, content binary")
    write_page_folders(rows, str(tmp_path / "p"), "title")
    assert sorted(x.split("/")[-1] for x in files_below(tmp_path / "p")) == ["title=...csv", "title=a%2Fb+c.csv"]
    with pytest.raises(FileExistsError):
        write_page_folders(rows, str(tmp_path / "p"), "title")
    with pytest.raises(Exception, match="line breaks"):
        write_page_folders(spark.createDataFrame([(1, bytearray(b"a\rb"))], SCHEMA), str(tmp_path / "broken"))
    write_page_folders(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert read_page_folders(spark, str(tmp_path / "none")).count() == 0


def test_other_file_systems_get_a_folder_a_page(spark, tmp_path, monkeypatch):
    for module in (tables, pages):
        monkeypatch.setattr(module, "mounted_path", lambda *_: None)
    path = str(tmp_path / "p")
    write_page_folders(spark.createDataFrame([(i, bytearray(b"%d" % i)) for i in range(5)], SCHEMA), path)
    assert sorted(x for x in os.listdir(path) if "=" in x) == [f"page_id={i}" for i in range(5)]
    assert sorted(r.html for r in read_page_folders(spark, path).collect()) == [str(i) for i in range(5)]


def test_mounted_paths(spark):
    assert mounted_path(spark, "file:///a/b c") == mounted_path(spark, "file:/a/b c") == mounted_path(spark, "/a/b c") == "/a/b c"
    assert mounted_path(spark, "hdfs://h/a") is None and mounted_path(spark, "s3a://b/a") is None
