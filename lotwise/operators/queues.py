"""What is looked at next: objects to check, pictures to fetch, cards to review.  Orders are total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.config import Config
from lotwise.operators import duplicates, status, upserts


def stalest_first(df: DataFrame, state: Column, seen_days: Column, checked_days: Column, id_col: str, n: int, cfg: Config = Config()) -> DataFrame:
    """The n objects that need a check and were not seen for the longest; of equal ones those of the highest ids."""
    return df.where(status.needs_check(state, seen_days, checked_days, cfg)).orderBy(seen_days.desc(), F.col(id_col).desc()).limit(n)


def download_order(photos: DataFrame, flagged: Column, own_host: str, n: int, id_col: str = "ad_id") -> DataFrame:
    """The first n pictures: of flagged objects, then from other hosts than the site's own (a pattern), then covers, then by id."""
    own = F.coalesce(F.col("url").rlike(f"//[^/]*{own_host}/"), F.lit(False))
    return photos.orderBy(F.coalesce(flagged, F.lit(False)).desc(), own, "position", id_col).limit(n)


def with_both_low(df: DataFrame, reasons: Column, iqr_flag: str = "iqr_flag") -> DataFrame:
    """both_detectors_low: 1 where the robust z and the quartile fences call the price too low."""
    both = F.contains(F.coalesce(reasons, F.lit("")), F.lit("price_anomaly_low")) & (F.col(iqr_flag) == "low")
    return df.withColumn("both_detectors_low", F.coalesce(both, F.lit(False)).cast("int"))


def review_order(df: DataFrame, id_col: str = "ad_id") -> DataFrame:
    """Those that both detectors call low first, then by price_z from the lowest."""
    return df.orderBy(F.desc("both_detectors_low"), F.asc_nulls_last("price_z"), id_col)


def card_rows(rows: DataFrame, extras: DataFrame, photos: DataFrame, journal: DataFrame, id_col: str = "ad_id", seq: str = "seq") -> DataFrame:
    """`rows` with the columns of `extras`, photos (addresses in order, none: empty) and existing_verdict, unlabelled ones first.

    existing_verdict is the last of a row's verdicts that is fraud or legit.
    """
    done = upserts.keep_last(journal.where(F.col("verdict").isin("fraud", "legit")).select(id_col, "verdict", seq), [id_col], seq)
    out = rows.join(extras, id_col, "left").join(duplicates.gallery(photos, id_col), id_col, "left").join(done.select(id_col, F.col("verdict").alias("existing_verdict")), id_col, "left")
    out = out.withColumn("photos", F.coalesce("urls", F.array().cast("array<string>"))).drop("urls")
    return out.orderBy(F.asc_nulls_first("existing_verdict"), F.asc_nulls_first("price_z"), id_col)
