"""Raw page sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersift.functions.charset import decode_bytes
from tickersift.functions.scratch import mounted_path

BATCH_BYTES = 8_000_000


def read_page_files(spark: SparkSession, path: str, charset: str = "GBK") -> DataFrame:
    """One row per stored page file: its path as ``url`` and its text as ``html``."""
    files = spark.read.format("binaryFile").load(path)
    return decode_pages(files.select(F.col("path").alias("url"), "content"), charset)


def packed_page_files(spark: SparkSession, path: str, charset: str = "GBK", glob: str = "*") -> DataFrame:
    """Page files below a folder, in the charset they were stored in.

    Page files are small and many: the reader puts files of ``spark.sql.files.maxPartitionBytes``
    in all into one task, each counted with ``openCostInBytes``. Broken bytes become U+FFFD
    and never fail the job; a file's last line feed is not part of the page.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return _lines(reader.load(path).select(F.col("path").alias("url"), "content"), charset)


def read_page_folders(spark: SparkSession, path: str, charset: str = "GBK") -> DataFrame:
    """What ``write_page_folders`` wrote, with the columns of ``packed_page_files``.

    Spark's sources keep every file they read in the driver's memory, 0.7 kB each. Here, on a
    mounted file system, the driver knows the folders only; a task lists one and reads its files.
    """
    root = mounted_path(spark, path)
    if root is None:
        return packed_page_files(spark, path, charset, "*.csv")
    folders = sorted(x for x in os.listdir(root) if not x.startswith("_"))
    most = BATCH_BYTES

    def read(batches):
        import pyarrow as pa

        def packed(urls, contents):
            return pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(contents, pa.binary())], names=["url", "content"])

        urls, contents, size = [], [], 0
        for i in (i for batch in batches for i in batch.column(0).to_pylist()):
            for name in sorted(os.listdir(f"{root}/{folders[i]}")):
                file = f"{root}/{folders[i]}/{name}"
                with open(file, "rb") as f:
                    contents.append(f.read())
                urls.append(f"file:{file}")
                size += len(contents[-1])
                if size > most:
                    yield packed(urls, contents)
                    urls, contents, size = [], [], 0
        yield packed(urls, contents)

    numbers = spark.range(0, len(folders), 1, max(1, len(folders)))
    return _lines(numbers.mapInArrow(read, "url string, content binary"), charset)


def _lines(files: DataFrame, charset: str) -> DataFrame:
    return decode_pages(files, charset).withColumn("html", F.regexp_replace("html", r"\n\z", ""))


def decode_pages(pages: DataFrame, charset: str = "GBK") -> DataFrame:
    """Turn the ``content`` bytes of each page into ``html`` text."""
    html = decode_bytes(pages.sparkSession, F.col("content"), charset)
    return pages.withColumn("html", html).drop("content")


def paged_urls(pages: DataFrame, url: str = "url", step: int = 10, count: int = 10) -> DataFrame:
    """The addresses of the listing parts behind each base address: offsets 0, step, ..."""
    base = F.regexp_replace(url, "[?#].*$", "")
    offsets = F.array(*[F.lit(i * step) for i in range(count)])
    return pages.select("*", F.explode(offsets).alias("offset")).withColumn(
        "page_url", F.concat(base, F.lit("?offset="), F.col("offset").cast("string"))
    )
