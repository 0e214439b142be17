"""The life of listings: what was last seen and checked, what is inferred, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.config import Config

TERMINAL = ("archived", "deleted")


def latest_status(journal: DataFrame, key: str, seq: str, status: str) -> DataFrame:
    return journal.groupBy(key).agg(F.max_by(status, seq).alias("status"), F.max(seq).alias("last_seq"))


def last_seen(sightings: DataFrame, key: str, day: str) -> DataFrame:
    return sightings.groupBy(key).agg(F.max(day).alias("last_seen"))


def inferred_active(status: Column, seen: Column, checked: Column) -> Column:
    """Seen on a list after its last check, and not marked active yet."""
    return F.coalesce(status != "active", F.lit(True)) & seen.isNotNull() & (checked.isNull() | (seen > checked))


def needs_check(status: Column, seen_days: Column, checked_days: Column, cfg: Config = Config()) -> Column:
    """Unseen for some days, not in a final state, and not checked recently (never counts as long ago)."""
    final = F.coalesce(status.isin(*TERMINAL), F.lit(False))
    recent = F.coalesce(checked_days < cfg.recheck_days, F.lit(False))
    return ~final & (seen_days >= cfg.stale_days) & ~recent


def daily_sightings(observed: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """The first observation of each object on each day."""
    day = F.to_date(ts)
    rest = [c for c in observed.columns if c not in (key, ts, seq)]
    return observed.groupBy(key, day.alias("seen_date")).agg(F.min_by(F.struct(seq, *rest), seq).alias("x")).select(key, "seen_date", "x.*")


def price_history(sightings: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each observation with the value before it and the first one (an extension)."""
    w = Window.partitionBy(key).orderBy(order)
    return sightings.withColumns({"previous": F.lag(value).over(w), "first_value": F.first(value).over(w), "change": F.col(value) - F.lag(value).over(w)})


def day_ledger(requests: DataFrame, ts: str, host: str, amount: Column, keep_days: int, as_of: Column) -> DataFrame:
    """Requests of each host on each of the last days."""
    rows = requests.withColumn("day", F.to_date(ts)).where((F.datediff(as_of, "day") < keep_days) & (F.datediff(as_of, "day") >= 0))
    return rows.groupBy("day", host).agg(F.sum(amount).alias("used"))


def null_profile(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Percentage of nulls of the columns with most, in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.select(F.expr(f"stack({len(columns)}, {pairs}) as (column_name, share)")).select("column_name", F.round(F.col("share") * 100, 4).alias("null_pct")).orderBy(F.desc("null_pct"), "column_name").limit(n)
