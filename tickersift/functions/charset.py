"""Legacy charsets. Spark 4 accepts only a few charsets unless told otherwise."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def allow_legacy_charsets(spark: SparkSession) -> None:
    """Accept every JVM charset; replace malformed bytes instead of failing the job."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def decode_bytes(spark: SparkSession, content: Column, charset: str = "GBK") -> Column:
    allow_legacy_charsets(spark)
    return F.decode(content, charset)


def encode_text(spark: SparkSession, text: Column, charset: str = "GBK") -> Column:
    allow_legacy_charsets(spark)
    return F.encode(text, charset)


def representable(spark: SparkSession, text: Column, charset: str = "GBK") -> Column:
    """The text with '?' for each character that the charset lacks."""
    return decode_bytes(spark, encode_text(spark, text, charset), charset)
