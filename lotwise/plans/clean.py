"""The clean layer: raw listings with everything known of them, flags and their reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.config import Config
from lotwise.functions import scalars as S
from lotwise.operators import duplicates, outliers, rules, upserts
from lotwise.sources import working

TIERS = [("model", ["model_key", "age_bucket"]), ("brand", ["brand", "age_bucket"]), ("age", ["age_bucket"])]
ENRICHED = {"customs_cleared": "string", "drive": "string", "steering": "string", "color": "string", "generation": "string", "page_mileage_km": "int", "damage_keywords": "string", "seller_comment": "string", "market_price": "double", "page_status_badge": "string"}


def clean(raw: DataFrame, enriched: DataFrame, journal: DataFrame, status: DataFrame, photo_pairs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Joins, then rules and outliers, then withdrawal, then reposts and pictures (which nothing withdraws), then the verdict.

    The rows are written twice while the query is built, before the outliers and
    before the reposts: both read them several times over.
    """
    facts = rules.ensure_columns(enriched, ENRICHED).select("ad_id", *ENRICHED)
    df = raw.join(facts, "ad_id", "left")
    df = df.withColumns({"mileage_km": F.coalesce(F.col("mileage_km").cast("double"), F.col("page_mileage_km").cast("double")), "text_full": F.coalesce("seller_comment", "description")})
    df = df.join(upserts.latest_verdict(journal, "ad_id", "seq", "verdict"), "ad_id", "left")
    df = rules.missing_indicators(rules.normalize(df, cfg), {"mileage_km": "is_mileage_missing", "description": "is_description_missing"})
    df = df.withColumn("rule_reasons", rules.hard_rules(F.col("year"), F.col("price_tenge"), F.col("mileage_km"), F.col("age"), F.col("condition"), cfg))
    df = df.withColumns({"log_price": F.ln("price_tenge"), "age_bucket": S.age_bucket(F.col("age")), "model_key": S.model_key(F.col("brand"), F.col("model"))})
    df = outliers.hierarchical_z(working.written(df), "log_price", TIERS, cfg)
    df = df.withColumns({"stat_reasons": outliers.stat_reasons(F.col("price_z"), cfg), "info_flags": F.lit("")})
    df = duplicates.reposts(working.written(rules.exculpate(df, cfg)), cfg=cfg)
    df = rules.finalize(duplicates.flag_pair_ends(df, photo_pairs))
    return df.join(status.select("ad_id", "status"), "ad_id", "left").withColumn("status", F.coalesce("status", F.lit("active")))


def two_passes(raw: DataFrame, journal: DataFrame, status: DataFrame, look: Callable[[DataFrame], tuple[DataFrame, DataFrame]], cfg: Config = Config()) -> DataFrame:
    """The clean layer twice: a first pass without facts from pages says what `look` looks at first, and its (facts, picture pairs) go into the second.

    `look` gets (ad_id, is_suspicious).
    """
    spark = raw.sparkSession
    no_facts = raw.select("ad_id", *[F.lit(None).cast(t).alias(c) for c, t in ENRICHED.items()]).limit(0)
    no_pairs = spark.createDataFrame([], "ad_id_a long, ad_id_b long")
    first = working.written(clean(raw, no_facts, journal, status, no_pairs, cfg).select("ad_id", "is_suspicious"))
    facts, pairs = look(first)
    return clean(raw, facts, journal, status, pairs, cfg)
