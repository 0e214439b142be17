"""Tables dealt into hash partitions of their keys, so that an upsert rewrites only the partitions that its rows touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import upserts
from lotwise.sources import working

PART = "key_part"


def _dealt(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Equal keys share a partition, null keys too."""
    return df.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def create(df: DataFrame, path: str, keys: list[str], parts: int) -> None:
    """Store the rows, one task for each partition; of equal keys any one row must be the only one."""
    _dealt(df, keys, parts).repartition(parts, PART).write.partitionBy(PART).mode("error").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def touched(rows: DataFrame, keys: list[str], parts: int) -> list[int]:
    """Numbers of the partitions that the keys fall in: at most `parts`, pre-aggregated by tasks."""
    return sorted(r[0] for r in _dealt(rows, keys, parts).select(PART).distinct().collect())


def merge(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], parts: int, update: list[str] | None = None, seq: str | None = None) -> list[int]:
    """Upsert `rows` into the table at `path` and return the partitions rewritten: known keys stay, or get the `update` columns.

    Only partitions that hold a key of `rows`, and in them a changed row, are
    read and replaced; files of all others keep their names.  What is merged is
    written aside first and then moved in partition by partition, so a merge
    that fails half-way is mended by repeating it, and a batch that was merged
    before changes nothing at all.  `parts` is that of `create`.
    """
    near = touched(rows, keys, parts)
    if not near:
        return []
    stored = spark.read.parquet(path)
    old = stored.where(F.col(PART).isin(near))
    table = old.drop(PART)
    merged = upserts.upsert_ignore(table, rows, keys, seq) if update is None else upserts.upsert_update(table, rows, keys, update, seq)
    merged = working.written(_dealt(merged.select(*table.columns), keys, parts))
    digest = lambda df: df.groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*table.columns).cast("decimal(20,0)")).alias("h"))
    before = digest(old).withColumnsRenamed({"n": "n0", "h": "h0", PART: "part0"})
    changed = digest(merged).join(before, F.col(PART) == F.col("part0"), "left").where(~(F.col("n").eqNullSafe(F.col("n0")) & F.col("h").eqNullSafe(F.col("h0"))))
    changed = sorted(r[PART] for r in changed.select(PART).collect())  # at most `parts`
    if changed:
        out = merged.where(F.col(PART).isin(changed)).repartition(len(changed), PART)
        out.write.partitionBy(PART).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return changed
