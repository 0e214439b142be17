"""Tables that cut lineage, written where every executor can read them again."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local() -> str:
    path = tempfile.mkdtemp(prefix="lotwise-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder if all of Spark runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = root or _local()
    return f"{root.rstrip('/')}/lotwise-{uuid.uuid4().hex}/{name}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back, so that a lost executor costs no more than the stage it ran."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
