"""Table, CSV and text sinks."""

from __future__ import annotations

import os
from contextlib import suppress
from datetime import date

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tickersift.functions.charset import allow_legacy_charsets, representable
from tickersift.functions.scratch import mounted_path


def dated(path: str, day: date) -> str:
    """A path that carries the day of the report: ``report`` -> ``report_20190813``."""
    return f"{path}_{day:%Y%m%d}"


def write_by_date(df: DataFrame, path: str, on: str = "bar_date", fmt: str = "parquet") -> None:
    """Overwrite a table partitioned by date.

    The rebalance hint gathers each date into few files and, with adaptive execution,
    splits a date that outgrows one task.
    """
    df.hint("rebalance", F.col(on)).write.mode("overwrite").partitionBy(on).format(fmt).save(path)


def export_day(df: DataFrame, path: str, day: date, on: str = "report_date", fmt: str = "parquet") -> None:
    """Put one day's report into a table partitioned by day, in place of what it had for that day.

    Running a day again replaces that day only: the rows carry the day as a constant, and
    only partitions that are written are overwritten. A day without rows leaves the table
    as it is.
    """
    dated_rows = df.withColumn(on, F.lit(day))
    writer = dated_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(on)
    writer.format(fmt).save(path)


# Quotes inside a value are doubled, as spreadsheets and other CSV writers do, and
# blanks around a value are part of it.
CSV_FORM = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> None:
    """Write CSV files with a header row; ``mode='append'`` adds to the folder.

    A text that the encoding cannot hold fails the job (see ``representable`` for a lossy form).
    """
    if encoding.upper() != "UTF-8":
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        df = df.withColumns({c: _held(df.sparkSession, c, encoding) for c in texts})
    df.write.mode(mode).options(**CSV_FORM, encoding=encoding).csv(path)


def _held(spark: SparkSession, column: str, encoding: str) -> Column:
    text = F.col(column)
    lost = F.raise_error(F.concat(F.lit(f"{column}: {encoding} cannot hold "), text))
    return F.when(text.isNull() | (representable(spark, text, encoding) == text), text).otherwise(lost)


def read_csv(
    spark: SparkSession, path: str, schema: str | StructType, encoding: str = "UTF-8", line_breaks: bool = False
) -> DataFrame:
    """Read such files. ``line_breaks`` allows them inside values; a file is then read by one task."""
    if encoding.upper() != "UTF-8":
        allow_legacy_charsets(spark)
    return spark.read.schema(schema).options(**CSV_FORM, encoding=encoding, multiLine=line_breaks).csv(path)


def write_page_files(df: DataFrame, path: str, name: str = "page_id", content: str = "content") -> None:
    """One file per page, of exactly the bytes of ``content`` and a line feed, in a folder named by ``name``.

    Bytes travel as the characters of the same number, so any charset, and bytes that are
    no text at all, come through. A page is one line: line breaks in it must be gone.
    """
    line = F.decode(F.col(content), "ISO-8859-1")
    once = F.when(line.rlike(r"[\r\n]"), F.raise_error(F.lit("a page has line breaks"))).otherwise(line)
    rows = df.select(F.col(name), once.alias("line"))
    plain = {"encoding": "ISO-8859-1", "quote": "", "sep": "\x01", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(**plain).partitionBy(name).csv(path)


def write_page_folders(df: DataFrame, path: str, name: str = "page_id", content: str = "content", pages: int = 1000) -> None:
    """The files of ``write_page_files``, ``pages`` of them to a folder: ``000003/page_id=7.csv``.

    On a mounted file system Hadoop starts a process or more for each file that it creates, to
    set its mode, and a folder for each page makes listing as dear as reading; so tasks write plain files
    there. Names are URL-encoded. Each task attempt writes to folders of its own, and those of the
    attempts that count are moved to ``path``, which must be new. Rows of one name that meet in a task share a
    file, and empty content leaves none, as in ``write_page_files``. Other file systems
    get that function's files, one folder a page. ``read_page_folders`` reads both.
    """
    root = mounted_path(df.sparkSession, path)
    if root is None:
        return write_page_files(df, path, name, content)
    begun = f"{root}/_begun"
    os.makedirs(root)
    os.mkdir(begun)

    def write(batches):
        import pyarrow as pa

        attempt = TaskContext.get().taskAttemptId()
        folders, files, last, out = [], 0, None, None
        try:
            for batch in batches:
                for key, line in zip(batch.column(0), batch.column(1), strict=True):
                    key, line = key.as_py(), line.as_py()
                    if not line:
                        continue
                    if b"\n" in line or b"\r" in line:
                        raise ValueError("a page has line breaks")
                    if key != last:
                        if out:
                            out.close()
                        if files % pages == 0:
                            folders.append(f"{begun}/{attempt}-{files // pages}")
                            os.mkdir(folders[-1])
                        out = open(f"{folders[-1]}/{key}.csv", "wb")
                        files, last = files + 1, key
                    out.write(line + b"\n")
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string())], names=["folder"])

    key = F.concat(F.lit(f"{name}="), F.coalesce(F.url_encode(F.nullif(F.col(name).cast("string"), F.lit(""))), F.lit("__HIVE_DEFAULT_PARTITION__")))
    rows = df.select(key.alias("key"), content).sortWithinPartitions("key")
    for i, row in enumerate(rows.mapInArrow(write, "folder string").collect()):  # one row a folder
        os.rename(row["folder"], f"{root}/{i:06d}")
    with suppress(OSError):  # what failed attempts left stays there, where readers don't look
        os.rmdir(begun)


def write_text_by_title(df: DataFrame, path: str, title: str = "title", text: str = "text") -> None:
    """One folder of text files per title. Meant for a moderate number of titles."""
    rows = df.select(F.col(title).alias("title"), F.col(text).alias("value"))
    rows.hint("rebalance", F.col("title")).write.mode("overwrite").partitionBy("title").option("lineSep", "\n").text(path)


def read_text_by_title(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, title string").option("lineSep", "\n").text(path)


def write_lines_by_title(df: DataFrame, path: str, title: str = "title", text: str = "text", part: str = "part") -> None:
    """One table of the lines of all texts, in the order of title, part and place in the text.

    Columns: title, part (which tells the texts of one title apart, and sorts them),
    position (from 0) and line. Texts are dealt by ranges of (title, part), so one title of
    many texts spans several tasks, and each file holds a range of titles: a reader of one
    title skips the other files and row groups by their statistics. However many titles
    there are, files are as many as tasks. A NULL text has no lines, an empty one an empty
    line; the NULL title is a title like any other. Texts with equal title and part cannot be
    told apart by a reader who sorts.
    """
    texts = df.select(F.col(title).alias("title"), F.col(part).alias("part"), F.split(F.col(text), "\n", -1).alias("lines"))
    placed = texts.repartitionByRange("title", "part").sortWithinPartitions("title", "part")
    placed.select("title", "part", F.posexplode("lines").alias("position", "line")).write.mode("overwrite").parquet(path)


def read_lines_of_title(spark: SparkSession, path: str, title: str | None) -> DataFrame:
    """Lines of one title, in order; only row groups that can hold it are read."""
    lines = spark.read.parquet(path).where(F.col("title").eqNullSafe(F.lit(title)))
    return lines.orderBy("part", "position")
