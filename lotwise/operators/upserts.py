"""Tables that grow: idempotent upserts, journals where the last row counts, filling of gaps, work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key, that of the highest seq; pre-aggregated, so a key with very many rows is no burden."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def upsert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """`table`, and those of `rows` whose keys it lacks; of rows with equal keys the last, by seq."""
    rows = keep_last(rows, keys, seq) if seq else rows.dropDuplicates(keys)
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_update(table: DataFrame, rows: DataFrame, keys: list[str], update: list[str], seq: str | None = None) -> DataFrame:
    """As upsert_ignore, but `update` columns of rows already there are taken from `rows`, nulls too."""
    rows = keep_last(rows, keys, seq) if seq else rows.dropDuplicates(keys)
    fresh = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rows.columns if c not in keys], F.lit(True).alias("_new"))
    both = table.withColumn("_old", F.lit(True)).join(fresh, keys, "full")
    pick = lambda c: F.when(F.col("_old").isNull() | (F.col("_new") & F.lit(c in update)), F.col(f"_new_{c}")).otherwise(F.col(c)) if f"_new_{c}" in fresh.columns else F.col(c)
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in table.columns])


def fill_if_null(table: DataFrame, rows: DataFrame, keys: list[str], columns: list[str], blank_too: tuple[str, ...] = ()) -> DataFrame:
    """Gaps of `table` filled from `rows`; in `blank_too` an empty text is a gap as well."""
    fresh = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    old = lambda c: F.nullif(F.col(c), F.lit("")) if c in blank_too else F.col(c)
    return table.join(fresh, keys, "left").select(*[F.coalesce(old(c), F.col(f"_new_{c}")).alias(c) if c in columns else F.col(c) for c in table.columns])


def is_gap(c: Column) -> Column:
    """What counts as unknown in a stored passport."""
    return c.isNull() | c.cast("string").isin("", "nan", "None")


def upgrade_passport(stored: DataFrame, fresh: DataFrame, key: str, fields: list[str], count_col: str | None = None, photo_col: str | None = None) -> DataFrame:
    """`stored` with gaps filled by what is known afresh, the larger picture count, and a whole picture in place of a preview.

    changed tells which rows differ; keys only in `fresh` are added (and changed).
    """
    new = fresh.select(key, *[F.col(c).alias(f"_new_{c}") for c in fresh.columns if c != key], F.lit(True).alias("_new"))
    both = stored.withColumn("_old", F.lit(True)).join(new, key, "full")
    out = {}
    for c in (c for c in stored.columns if c != key):
        old, now = F.col(c), F.col(f"_new_{c}") if c in fresh.columns else F.lit(None)
        if c in fields:
            value = F.when(is_gap(old) & now.isNotNull() & (now.cast("string") != ""), now).otherwise(old)
        elif c == count_col:
            value = F.greatest(old, now)
        elif c == photo_col:
            better = F.contains(now, F.lit("-full.")) & ~F.coalesce(F.contains(old, F.lit("-full.")), F.lit(False))
            value = F.when(F.coalesce(better, F.lit(False)), now).otherwise(old)
        else:
            value = old
        out[c] = F.when(F.col("_old").isNull(), now).otherwise(value)
    differs = [~out[c].eqNullSafe(F.col(c)) for c in out]
    changed = F.col("_old").isNull()
    for d in differs:
        changed = changed | d
    return both.select(key, *[v.alias(c) for c, v in out.items()], changed.alias("changed"))


def collapse_journal(df: DataFrame, keys: list[str], seq: str, verdict: str, comment: str | None = None) -> DataFrame:
    """One row for each key: the place of its first row, and the verdict (and comment) of its last row with one."""
    said = F.trim(F.coalesce(verdict, F.lit(""))) != ""
    values = F.struct(F.col(verdict).alias("v"), (F.col(comment) if comment else F.lit(None).cast("string")).alias("c"))
    out = df.groupBy(*keys).agg(F.min(seq).alias("first_seq"), F.max_by(values, F.when(said, F.col(seq))).alias("_last"))
    return out.select(*keys, "first_seq", F.col("_last.v").alias(verdict), *([F.col("_last.c").alias(comment)] if comment else []))


def latest_verdict(df: DataFrame, key: str, seq: str, verdict: str) -> DataFrame:
    """The last verdict that is not blank, stripped and in lower case."""
    plain = F.lower(F.trim(verdict))
    return df.withColumn("_v", plain).where("_v <> ''").groupBy(key).agg(F.max_by("_v", seq).alias(verdict))


def set_verdicts(journal: DataFrame, verdicts: DataFrame, key: str, seq: str, verdict: str = "verdict", allowed: tuple[str, ...] = ("fraud", "legit", "unknown")) -> DataFrame:
    """Valid verdicts put into each key's first row (its other rows go), or into a new row."""
    fresh = verdicts.where(F.col(verdict).isin(*allowed)).select(F.col(key).alias("_key"), F.col(verdict).alias("_verdict"), F.col(seq).alias("_seq"))
    fresh = keep_last(fresh, ["_key"], "_seq").drop("_seq")
    first = Window.partitionBy(key).orderBy(seq)
    rows = journal.withColumn("_rn", F.row_number().over(first)).join(fresh, F.col(key) == F.col("_key"), "full")
    rows = rows.where(F.col("_verdict").isNull() | (F.coalesce("_rn", F.lit(1)) == 1))
    return rows.select(*[F.coalesce(key, "_key").alias(key) if c == key else F.coalesce("_verdict", verdict).alias(c) if c == verdict else F.col(c) for c in journal.columns])


def work_queue(items: DataFrame, done: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n items that are not done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti").orderBy(*order, key).limit(n)
