"""Tables, CSV files, JSON state and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def table_or_empty(spark: SparkSession, name: str, schema: StructType | str) -> DataFrame:
    """A catalogue table, or no rows of the given schema if it does not exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else empty(spark, schema)


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header and stated types; nothing is inferred."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def csv_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An optional CSV file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return csv(spark, path, schema) if found else empty(spark, schema)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; filters and columns are pushed down by Spark."""
    return spark.read.jdbc(url, table, properties=options)


def day_state(spark: SparkSession, path: str) -> DataFrame:
    """(day, host, used) of a state file {day: {host: n}}, in its older form {day: n} too; what cannot be read is no state."""
    text = spark.read.text(path, wholetext=True)
    hosts = F.from_json("value", "map<string, map<string, bigint>>")
    plain = F.from_json("value", "map<string, bigint>")
    newer = text.select(F.explode(hosts).alias("day", "hosts")).where("hosts is not null").select("day", F.explode("hosts").alias("host", "used"))
    older = text.select(F.explode(plain).alias("day", "used")).where("used is not null").select("day", F.lit("all").alias("host"), "used")
    return newer.unionByName(older)


def count_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """n: lines of a log that match."""
    return spark.read.text(path).agg(F.count_if(F.col("value").rlike(pattern)).alias("n"))


def images(spark: SparkSession, path: str, most_bytes: int = 5_000_000) -> DataFrame:
    """(path, length, content) of picture files up to a size."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes).select("path", "length", "content")
