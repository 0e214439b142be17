"""Robust outliers: median and MAD with fallback tiers, and quartile fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.config import Config
from lotwise.functions import scalars as S
from lotwise.operators import quantiles, tiers


def hierarchical_z(df: DataFrame, value: str, named_tiers: list[tuple[str, list[str]]], cfg: Config = Config()) -> DataFrame:
    """price_z and z_group_level: the robust z of the first tier with at least min_group rows.

    A tier is used where all its keys are known and it counts enough rows, those
    without a value too.  Its z is 0 if the MAD is 0; a row without a value has
    no z there and falls to the next tier, and has none if the last is no better.
    Rows that no tier serves have 0 and an empty level.  z is rounded half to
    even, before anyone compares it.
    Equal values of equal keys are counted once for all tiers, and the rows are
    joined once, with what serves their combination of keys.
    """
    names, keys = [name for name, _ in named_tiers], [own for _, own in named_tiers]
    rows = df.select(*tiers.all_keys(keys), F.col(value).alias("_x"))
    valueless = F.when(F.coalesce("mad", F.lit(0.0)) == 0, tiers.place()).otherwise(2 * len(keys) - tiers.place())  # a flat tier, else the last one
    stats = _spread(rows, keys, quantiles.is_large(df)).where(F.col("n") >= cfg.min_group)
    served = tiers.first_served(rows, stats, keys, False, {"_first": (tiers.place(), ["med", "mad"]), "_else": (valueless, ["med", "mad"])})
    out = tiers.join_back(df, served, keys)
    tier, med, mad = (F.when(F.col(value).isNull(), F.col(f"_else.{x}")).otherwise(F.col(f"_first.{x}")) for x in ("_tier", "med", "mad"))
    z = F.when(F.coalesce(mad, F.lit(0.0)) == 0, 0.0).otherwise(cfg.mad_scale * (F.col(value) - med) / F.nullif(mad, F.lit(0.0)))
    level = F.coalesce(*[F.when(tier == i, name) for i, name in enumerate(names)], F.lit(""))
    return out.withColumns({"price_z": F.when(tier.isNull(), 0.0).otherwise(S.round_even(z)), "z_group_level": level}).drop("_first", "_else")


def _spread(rows: DataFrame, keys: list[list[str]], large: bool) -> DataFrame:
    """(_group, n, med, mad) of the groups of all tiers; exact, and split within groups where the table is large."""
    off = F.abs(F.col("_x") - F.col("med"))
    if large:
        every = rows.select(tiers.groups(keys), "_x")
        med = every.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).join(quantiles.group_quantile(every, ["_group"], "_x", 0.5, large).withColumnRenamed("q", "med"), "_group", "left")
        mad = quantiles.group_quantile(every.join(med, "_group").select("_group", off.alias("_x")), ["_group"], "_x", 0.5, large).withColumnRenamed("q", "mad")
        return med.join(mad, "_group", "left")
    counts = tiers.counted(rows, keys, False, c=F.count(F.lit(1)))
    med = counts.groupBy("_group").agg(F.percentile("_x", F.lit(0.5), F.col("c")).alias("med"), F.sum("c").alias("n"))
    mad = counts.join(med, "_group").groupBy("_group").agg(F.percentile(off, F.lit(0.5), F.col("c")).alias("mad"))
    return med.join(mad, "_group")


def stat_reasons(z: Column, cfg: Config = Config()) -> Column:
    return F.when(z < -cfg.z_threshold, "price_anomaly_low").when(z > cfg.z_threshold, "price_anomaly_high").otherwise("")


def iqr_fences(df: DataFrame, value: str, group: str, cfg: Config = Config()) -> DataFrame:
    """iqr_low, iqr_high and iqr_flag (low, high or '') from the quartiles of each group; a null group has none."""
    known = df.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), value)
    if quantiles.is_large(df):
        low, high = (quantiles.group_quantile(known, ["_g"], value, share, large=True).withColumnRenamed("q", name) for share, name in ((0.25, "_q1"), (0.75, "_q3")))
        q = low.join(high, "_g")
    else:
        q = known.groupBy("_g").agg(F.percentile(value, F.lit(0.25)).alias("_q1"), F.percentile(value, F.lit(0.75)).alias("_q3"))
    step = cfg.iqr_multiplier * (F.col("_q3") - F.col("_q1"))
    q = q.select("_g", (F.col("_q1") - step).alias("iqr_low"), (F.col("_q3") + step).alias("iqr_high"))
    df = df.join(F.broadcast(q), F.col(group) == F.col("_g"), "left").drop("_g")  # a row for each bucket of age
    flag = F.when(F.col(value) < F.col("iqr_low"), "low").when(F.col(value) > F.col("iqr_high"), "high").otherwise("")
    return df.withColumn("iqr_flag", flag)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order that must be total."""
    return df.orderBy(*order).limit(n)


def hash_sample(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """A fixed sample: the n rows with the smallest MD5 of their ids."""
    return df.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(n)
