"""Intermediate results that several branches of a plan read, written once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


#: For rows of some MB each: row groups are closed at about 4 MB, as a reader holds a whole one.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"}


def written(df: DataFrame, **options: str) -> DataFrame:
    """The rows, written as Parquet under spark.checkpoint.dir and read again.

    Where that setting is missing, a folder of this machine serves, but only if all of Spark runs in this process.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or f"file://{tempfile.mkdtemp(prefix='lotwise-')}"
    path = f"{base.rstrip('/')}/working-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
