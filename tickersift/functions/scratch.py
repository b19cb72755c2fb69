"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only a local run may do without that setting; it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="tickersift-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The path for plain file calls, if it is one of a mounted file system (``file:``, or the default one if that is local)."""
    if not re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        return os.path.abspath(path) if default.startswith("file:") else None
    return re.sub("^file:/+", "/", path) if path.startswith("file:/") else None


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back.

    Later readers neither recompute it nor see other values for it, also after the
    loss of an executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
