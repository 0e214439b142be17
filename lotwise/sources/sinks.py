"""Writing tables, reports and models."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import upserts


def replace_table(df: DataFrame, name: str) -> None:
    """A derived table, replaced as a whole."""
    df.write.mode("overwrite").saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for reports; whole numbers stay whole and nulls are empty."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def merge_table(spark: SparkSession, name: str, rows: DataFrame, keys: list[str], update: list[str] | None = None, seq: str | None = None) -> None:
    """Upsert into a stored table: nothing is done for known keys, or `update` columns are set. No rows change nothing."""
    table = spark.table(name)
    merged = upserts.upsert_ignore(table, rows, keys, seq) if update is None else upserts.upsert_update(table, rows, keys, update, seq)
    swap_table(merged.select(*table.columns), name)


def swap_table(df: DataFrame, name: str) -> None:
    """Write the rows beside the table, which they may read, and put them in its place by renaming: a failure while writing changes nothing."""
    spark, staged, old = df.sparkSession, f"{name}_staged", f"{name}_replaced"
    df.write.mode("overwrite").saveAsTable(staged)
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def restore_table(spark: SparkSession, name: str) -> None:
    """After a failure between the two renames: the old rows are the table again."""
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(f"{name}_replaced"):
        spark.sql(f"ALTER TABLE {name}_replaced RENAME TO {name}")


def migrate_csv(spark: SparkSession, rows: DataFrame, name: str, keys: list[str], seq: str | None = None) -> None:
    """A CSV's rows into a table that may not exist yet; of equal keys the last by seq."""
    rows = upserts.keep_last(rows, keys, seq) if seq else rows.dropDuplicates(keys)
    if spark.catalog.tableExists(name):
        merge_table(spark, name, rows, keys)
    else:
        replace_table(rows, name)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """n and a digest of the rows, whatever their order: sums of 64-bit hashes, so that no task holds them all."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns])), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("digest"))


def save_model(model, path: str, meta: dict) -> None:
    """A fitted pipeline, and what is known of it beside."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str, schema_version: int):
    """(model, meta); an artifact of another version is refused."""
    from pyspark.ml import PipelineModel

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("schema_version") != schema_version:
        raise ValueError(f"the artifact has schema version {meta.get('schema_version')}, not {schema_version}")
    return PipelineModel.load(f"{path}/model"), meta


def report_html(title: str, tables: dict[str, DataFrame], most_rows: int = 200) -> str:
    """A page with the first rows of each table."""
    from html import escape

    parts = [f"<h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most_rows).collect()
        cells = lambda xs, tag: "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in xs)
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{cells(df.columns, 'th')}</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows) + "</table>")
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title>" + "".join(parts)


def log_histogram(df: DataFrame, value: Column, low: float | None, high: float | None, bins: int) -> DataFrame:
    """(bin, n): counts over bins of equal width in log10; bin 0 lies below, bins + 1 above.

    A bound that is None is the least or greatest log of the table, and the last bin then holds the greatest too.
    """
    rows = df.where(value > 0).select(F.log10(value).alias("_x"))
    ends = rows.agg(F.min("_x").alias("_min"), F.max("_x").alias("_max")) if low is None or high is None else None
    rows = rows if ends is None else rows.join(F.broadcast(ends), how="cross")  # one row
    x, lo, hi = F.col("_x"), F.col("_min") if low is None else F.lit(low), F.col("_max") if high is None else F.lit(high)
    inside = F.floor((x - lo) / (hi - lo) * bins) + 1
    above = (x >= hi) if high is not None else F.lit(False)
    last = F.lit(False) if high is not None else x == hi
    at = F.when(x < lo, 0).when(above, bins + 1).when(last, bins).otherwise(inside).cast("int")
    return rows.select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
