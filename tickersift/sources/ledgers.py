"""Broker ledgers: one file (or folder) per sheet, every value read as text."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickersift.functions.charset import allow_legacy_charsets
from tickersift.sources.schemas import LEDGER_HEADER


def read_sheets(spark: SparkSession, sheets: Mapping[str, str], encoding: str = "UTF-8") -> DataFrame:
    """Append all sheets, given as sheet name -> CSV path with a header row.

    Sheets may differ in their columns and in column order: columns are matched by
    name and an absent one is NULL, like a blank cell. Use :func:`read_uniform_sheets` when all sheets
    share one layout.
    """
    if encoding.upper() != "UTF-8":
        allow_legacy_charsets(spark)
    parts = [
        _english(spark.read.options(header=True, escape='"', encoding=encoding).csv(path).withColumn("sheet", F.lit(name)))
        for name, path in sheets.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_uniform_sheets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Many sheets of one layout in a single scan; ``sheet`` is the file name."""
    rows = spark.read.schema(schema).options(header=True, escape='"').csv(path)
    return _english(rows.select("*", F.col("_metadata.file_name").alias("sheet")))


def sheet_name() -> Column:
    """A sheet's name: that of its file, or of its ``sheet=...`` folder."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, "sheet=([^/]*)", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, "([^/]*?)(?:[.][^/.]*)?$", 1))


def read_sheet_folder(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All sheets below a folder, however many: one scan for each layout among them.

    A sheet's first line tells its layout; the driver opens each file for that line alone.
    Sheets with the same columns in the same order are then read together, and layouts are
    appended by name. ``sheet`` is the name of the file or of its folder.
    """
    if encoding.upper() != "UTF-8":
        allow_legacy_charsets(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)
    names = sorted(r["path"] for r in files.select("path").collect())  # the content is not read
    layouts: dict[tuple[str, ...], list[str]] = {}
    for name, header in _headers(spark, names, encoding).items():
        layouts.setdefault(header, []).append(name)
    parts = []
    for header, paths in sorted(layouts.items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        rows = spark.read.schema(schema).options(header=True, escape='"', encoding=encoding).csv(paths)
        parts.append(_english(rows.select("*", sheet_name().alias("sheet"))))
    if not parts:
        raise ValueError(f"no sheet below {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _headers(spark: SparkSession, paths: Sequence[str], encoding: str) -> dict[str, tuple[str, ...]]:
    """The columns of each file, by its first line."""
    java, conf = spark._jvm.java.io, spark._jsc.hadoopConfiguration()
    found = {}
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        lines = java.BufferedReader(java.InputStreamReader(path.getFileSystem(conf).open(path), encoding))
        try:
            line = lines.readLine()
        finally:
            lines.close()
        if line:  # a file without a line is no sheet
            found[name] = tuple(next(csv.reader([line.removeprefix("\ufeff")])))
    return found


def _english(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in LEDGER_HEADER.items() if k in df.columns})
