"""A ledger fed by a stream, in which every batch counts once however often it is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "day date, kind string, used long"


def _folder(path: str, query: str, batch: int) -> str:
    return f"{path}/entries/query={query}/batch={batch}"


def writer(path: str, query: str, ts: str, kind: str, used: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: sums of a batch by day and kind, under the name of the query and the number of the batch.

    A batch that is tried again, after a crash at any point, replaces what its
    first try left; a commit is written last, and only batches with a commit are
    read.  Each batch adds as many rows as it has days and kinds.
    """

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.to_date(ts).alias("day"), F.col(kind).alias("kind")).agg(F.sum(used).cast("long").alias("used"))
        sums.coalesce(1).write.mode("overwrite").parquet(_folder(path, query, number))  # a row for each day and kind
        done = batch.sparkSession.createDataFrame([(query, number)], "query string, batch long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{query}-{number}")

    return write


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch) of the batches that count."""
    return spark.read.schema("query string, batch long").option("recursiveFileLookup", "true").parquet(f"{path}/commits")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(day, kind, used) over all committed batches of all queries."""
    schema = T.StructType([*T.StructType.fromDDL(ENTRY).fields, T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())])
    entries = spark.read.schema(schema).option("basePath", f"{path}/entries").parquet(f"{path}/entries")
    return entries.join(committed(spark, path), ["query", "batch"], "left_semi").groupBy("day", "kind").agg(F.sum("used").alias("used"))


def compact(spark: SparkSession, path: str, into: str) -> None:
    """All committed batches as one table, by day, for readers that want few files."""
    ledger(spark, path).repartition("day").write.mode("overwrite").partitionBy("day").parquet(into)
