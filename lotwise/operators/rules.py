"""The rule engine: normalising, hard rules with reasons, withdrawal of explained flags, and the final verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.config import Config
from lotwise.functions import scalars as S
from lotwise.functions import text as X

NEW, USED = "новый", "б/у"
TEXT_COLUMNS = ["brand", "model", "city", "condition", "body_type", "engine_type", "transmission"]


def ensure_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Typed nulls for columns that a frame lacks."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def expect_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Raise if a frame's columns have drifted from the contract."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    if have != want:
        raise ValueError(f"columns differ: {sorted(set(map(str, have.items())) ^ set(map(str, want.items())))}")
    return df


def joined_reasons(*parts: Column) -> Column:
    """Non-empty parts joined with '|'."""
    return F.array_join(F.array_remove(F.array_compact(F.array(*parts)), ""), "|")


def normalize(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    numbers = {c: F.col(c).try_cast("double") for c in ("price_tenge", "year", "mileage_km", "engine_volume") if c in df.columns}
    texts = {c: X.strip(F.col(c)) for c in TEXT_COLUMNS if c in df.columns}
    df = ensure_columns(df.withColumns(numbers | texts), {"condition": "string", "labels": "string"})
    condition = F.when(F.col("condition").isNull() & F.contains(F.col("labels"), F.lit("Новая")), NEW).otherwise(F.col("condition"))
    return df.withColumns({"condition": condition, "age": S.age(F.col("year"), cfg.as_of_year)})


def missing_indicators(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A 0/1 column for each column that may be null."""
    return df.withColumns({name: F.col(c).isNull().cast("int") for c, name in columns.items()})


def hard_rules(year: Column, price: Column, mileage: Column, age: Column, condition: Column, cfg: Config = Config()) -> Column:
    """Reasons joined with '|', in a fixed order.  A null never fires a rule; at age 0 any mileage is too much a year."""
    per_year = F.when(age == 0, mileage > 0).otherwise(mileage / F.nullif(age, F.lit(0)) > cfg.max_km_per_year)
    rules = {
        "year_too_old": year < cfg.min_year,
        "year_in_future": year > cfg.as_of_year + 1,
        "price_too_low": price < cfg.min_price,
        "price_too_high": price > cfg.max_price,
        "mileage_extreme": mileage > cfg.max_mileage,
        "used_but_zero_mileage": (condition == USED) & (mileage == 0) & (age >= 2),
        "km_per_year_extreme": per_year,
        "young_car_cheap": (age <= cfg.young_age) & (price < cfg.young_price) & (condition != NEW),
    }
    return joined_reasons(*[F.when(rule, name) for name, rule in rules.items()])


def scrub_mileage(df: DataFrame, column: str = "mileage_km") -> DataFrame:
    """Junk values become null; is_junk tells which."""
    junk = S.is_junk_mileage(F.col(column))
    return df.withColumn("is_junk", junk).withColumn(column, F.when(~junk, F.col(column)))


def dealer_strict(condition: Column, labels: Column) -> Column:
    return F.coalesce(condition == NEW, F.lit(False)) | F.coalesce(labels.rlike("От дилера|Новая"), F.lit(False))


def dealer_official(condition: Column, labels: Column) -> Column:
    return F.coalesce(condition == NEW, F.lit(False)) | F.coalesce(labels.rlike("(?iu)официальный дилер"), F.lit(False))


def dealer_any(condition: Column, labels: Column) -> Column:
    return F.coalesce(condition == NEW, F.lit(False)) | F.coalesce(labels.rlike("(?iu)дилер|новая"), F.lit(False))


def near_market(price: Column, market: Column, share: float) -> Column:
    return F.coalesce((market > 0) & (price >= share * market), F.lit(False))


OPTIONAL = {"price_tenge": "double", "damage_keywords": "string", "customs_cleared": "string", "verdict": "string", "page_status_badge": "string", "market_price": "double", "rule_reasons": "string", "stat_reasons": "string", "info_flags": "string", "text_full": "string", "description": "string", "seller_comment": "string", "condition": "string", "labels": "string"}


def exculpate(df: DataFrame, cfg: Config = Config(), damage=X.has_damage) -> DataFrame:
    """Withdraw low-price flags that facts explain, step by step; each step reads what the one before left.

    stat_reasons, rule_reasons and info_flags are joined with '|'; they are
    arrays between the steps.
    """
    extra = [c for c in OPTIONAL if c not in df.columns]
    df = ensure_columns(df, OPTIONAL)
    split = lambda c: F.array_remove(F.split(F.coalesce(F.col(c), F.lit("")), "[|]"), "")
    df = df.withColumns({"_stat": F.coalesce("stat_reasons", F.lit("")), "_rule": split("rule_reasons"), "_info": split("info_flags")})
    said = lambda c: F.coalesce(c, F.lit(False))
    explained = (
        said(damage(F.col("text_full")))
        | said(F.col("damage_keywords") != "")
        | said(F.col("customs_cleared") == "Нет")
        | said(F.col("verdict") == "legit")
        | said(F.col("page_status_badge").rlike("(?iu)аварийн|не на ходу|заложен"))
    )
    df = df.withColumn("_explained", explained)
    low, young = F.col("_stat") == "price_anomaly_low", F.array_contains("_rule", "young_car_cheap")

    def clear(df: DataFrame, when: Column, flag: str) -> DataFrame:
        df = df.withColumn("_when", when)
        return df.withColumns({"_info": F.when(F.col("_when"), F.array_union("_info", F.array(F.lit(flag)))).otherwise(F.col("_info")), "_stat": F.when(F.col("_when"), "").otherwise(F.col("_stat"))})

    df = clear(df, low & F.col("_explained"), "low_price_explained")
    df = df.withColumn("_when", young & F.col("_explained"))
    df = df.withColumns({"_info": F.when(F.col("_when"), F.array_union("_info", F.array(F.lit("low_price_explained")))).otherwise(F.col("_info")), "_rule": F.when(F.col("_when"), F.array_remove("_rule", "young_car_cheap")).otherwise(F.col("_rule"))})
    df = clear(df, low & dealer_official(F.col("condition"), F.col("labels")), "dealer_financing_price")
    df = clear(df, low & near_market(F.col("price_tenge"), F.col("market_price"), cfg.near_market), "market_price_ok")
    urgent = said(F.contains(F.lower("description"), F.lit(X.URGENT))) | said(F.contains(F.lower("seller_comment"), F.lit(X.URGENT)))
    df = df.withColumn("_stat", F.when(low & urgent, "price_anomaly_low|cheap_and_urgent").otherwise(F.col("_stat")))
    df = df.withColumn("_stat", F.when(said(F.col("verdict") == "fraud") & (F.col("_stat") == ""), "confirmed_by_review").otherwise(F.col("_stat")))
    out = df.withColumns({"stat_reasons": F.col("_stat"), "rule_reasons": F.array_join("_rule", "|"), "info_flags": F.array_join("_info", "|")})
    return out.drop("_stat", "_rule", "_info", "_explained", "_when", *[c for c in extra if c not in ("stat_reasons", "rule_reasons", "info_flags")])


def finalize(df: DataFrame, parts: tuple[str, ...] = ("rule_reasons", "stat_reasons", "dup_reasons", "photo_reasons")) -> DataFrame:
    """suspicion_reasons from the non-empty parts, and is_suspicious; the parts go."""
    df = ensure_columns(df, dict.fromkeys(parts, "string"))
    df = df.withColumn("suspicion_reasons", joined_reasons(*map(F.col, parts)))
    return df.withColumn("is_suspicious", (F.col("suspicion_reasons") != "").cast("int")).drop(*parts)
