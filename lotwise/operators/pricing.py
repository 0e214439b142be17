"""A fair price and its floor: folds without leaks, hierarchical baselines, metrics, calibration, models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.config import Config
from lotwise.functions import scalars as S
from lotwise.operators import quantiles, tiers
from lotwise.sources import working

#: What a price model must never see, for it follows from the price or from the verdict.
BANNED = ("price_tenge", "log_price", "price_z", "market_price", "suspicion_reasons", "is_suspicious", "verdict", "residual", "floor")
NUMERIC = ("age", "mileage_km", "engine_volume", "photos_count", "is_mileage_missing", "is_vip", "has_monthly_price")
CATEGORICAL = ("brand", "model", "engine_type", "transmission", "body_type", "condition")

#: Rows that one task of a fit holds.
PART_ROWS = 50_000


def check_features(columns: list[str]) -> list[str]:
    if leaks := sorted(set(columns) & set(BANNED)):
        raise ValueError(f"features that leak the price: {leaks}")
    return columns


def with_fold(df: DataFrame, group: Column, folds: int) -> DataFrame:
    """A fold for each row; rows of one group share it."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def balanced_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """A fold for each row, at most `folds` and no more than there are groups; rows of one group share it (nulls are a group).

    Large groups go, from the largest, to the fold with the fewest rows so far;
    these are at most 100 for each fold, and all groups if there are no more.
    The others are dealt by hash, in proportion to the room that is left in each fold.
    """
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("c"))
    total, n = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if n < 2:
        raise ValueError("folds need two groups at least")
    folds, most = min(folds, n), 100 * folds
    large = sizes if n <= most else sizes.where(F.col("c") * most >= total)
    loads, rows = [0] * folds, []
    for r in large.orderBy(F.desc("c"), "_group").collect():  # at most `most` rows
        lightest = loads.index(min(loads))
        loads[lightest] += r["c"]
        rows.append((r["_group"], lightest))
    placed = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_group", df.schema[group].dataType), T.StructField("_placed", T.IntegerType())]))
    room = [max(0.0, total / folds - x) for x in loads]
    point = F.conv(F.substring(F.md5(F.coalesce(F.col(group).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 2**32 * sum(room)
    dealt = F.lit(folds - 1)
    for f in reversed(range(folds - 1)):
        dealt = F.when(point < sum(room[: f + 1]), f).otherwise(dealt)
    out = df.join(F.broadcast(placed), F.col(group).eqNullSafe(F.col("_group")), "left")
    return out.withColumn("fold", F.coalesce(F.col("_placed"), dealt)).drop("_group", "_placed")


def hierarchical(df: DataFrame, value: str, keys: list[list[str]], folds: list[int], stat=0.5, learn: Column | None = None) -> DataFrame:
    """Out-of-fold statistic of the finest tier that has training rows; `df` has a fold.

    `stat` is the share of a quantile, which is split within large groups, or an
    aggregate of a column.  A training row counts for every other fold, if
    `learn` holds.  Keys match null with null.  The last tier is the whole
    training set.  Equal values of equal keys are counted by fold once; every
    tier and fold draws its quantile from these counts, and the rows are joined once.
    """
    keys = [*keys, []]
    rows = df.where(F.col(value).isNotNull() & (F.lit(True) if learn is None else learn)).select(*tiers.all_keys(keys), F.col(value).alias("_x"), F.col("fold").alias("_fold"))
    served = tiers.first_served(df, _other_folds(rows, keys, folds, stat, quantiles.is_large(df)), keys, True, {f"_p{i}": (F.when(F.col(f"q{i}").isNotNull(), tiers.place()), [f"q{i}"]) for i in range(len(folds))})
    own = [F.when(F.col("fold") == f, F.col(f"_p{i}.q{i}")) for i, f in enumerate(folds)]
    return tiers.join_back(df, served, keys).withColumn("predicted", F.coalesce(*own)).drop(*[f"_p{i}" for i in range(len(folds))])


def _other_folds(rows: DataFrame, keys: list[list[str]], folds: list[int], stat, large: bool) -> DataFrame:
    """(_group, q0, q1, ...): the statistic of each group's rows in other folds than the first, the second, ...; null without rows."""
    if not isinstance(stat, float):
        every = rows.select(tiers.groups(keys, nulls=True), "_x", "_fold")
        return every.groupBy("_group").agg(*[stat(F.when(F.col("_fold") != f, F.col("_x"))).alias(f"q{i}") for i, f in enumerate(folds)])
    if large:
        every = rows.select(tiers.groups(keys, nulls=True), "_x", F.array_remove(F.array(*map(F.lit, folds)), F.col("_fold")).alias("_for")).withColumn("_for", F.explode("_for"))
        q = quantiles.group_quantile(every, ["_group", "_for"], "_x", stat, large)
        return q.groupBy("_group").agg(*[F.max(F.when(F.col("_for") == f, F.col("q"))).alias(f"q{i}") for i, f in enumerate(folds)])
    counts = tiers.counted(rows, keys, True, **{f"c{i}": F.count_if(F.col("_fold") != f) for i, f in enumerate(folds)})
    return counts.groupBy("_group").agg(*[F.percentile("_x", F.lit(stat), F.col(f"c{i}")).alias(f"q{i}") for i in range(len(folds))])


def temporal_holdout(df: DataFrame, ts: str, id_col: str, group: str, test_share: float = 0.2) -> DataFrame:
    """part: 'test' for the newest rows by (ts, id), 'train' for others, null for older rows of a group in test or without ts.

    Ranks come from counts of each day, so that no task sorts the whole table.
    """
    known = df.where(F.col(ts).isNotNull()).withColumn("_day", F.to_date(ts))
    days = known.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each day
    total = days.agg(F.sum("_n").alias("_total"))
    ranked = known.join(before, "_day").join(F.broadcast(total), how="cross")  # one row
    ranked = ranked.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_day").orderBy(ts, id_col)))
    ranked = ranked.withColumn("_test", F.col("_rank") > F.floor(F.col("_total") * (1 - test_share)))
    held = ranked.where("_test").select(F.col(group).alias("_held")).distinct()
    ranked = ranked.join(held.withColumn("_in", F.lit(True)), F.col(group).eqNullSafe(F.col("_held")), "left")
    part = F.when(F.col("_test"), "test").when(F.col("_in").isNull(), "train")
    out = ranked.withColumn("part", part).drop("_day", "_before", "_total", "_rank", "_test", "_held", "_in")
    return out.unionByName(df.where(F.col(ts).isNull()).withColumn("part", F.lit(None).cast("string")))


def group_point(group: str, seed: int = 0) -> Column:
    """A whole number from 0 to 2**32 - 1, the same for all rows of a group."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(seed), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long")


def sample_groups(df: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """Whole groups, about `share` of them, always the same."""
    return df.where(group_point(group, seed) < F.lit(int(share * 2**32)))


def regression_metrics(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """mape and mae of prices, and r2 of their logs about the mean."""
    rows = df.select(actual.cast("double").alias("y"), predicted.cast("double").alias("p")).withColumns({"ly": F.ln("y"), "lp": F.ln("p")})
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("p")) / F.col("y")).alias("mape"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), F.sum((F.col("ly") - F.col("lp")) ** 2).alias("_e"), (F.sum(F.col("ly") * F.col("ly")) - F.sum("ly") * F.sum("ly") / F.count("ly")).alias("_d"))
    return sums.select("n", "mape", "mae", (1 - F.try_divide("_e", "_d")).alias("r2_log"))


def segment_metrics(df: DataFrame, actual: Column, predicted: Column, cuts: tuple[float, ...]) -> DataFrame:
    """mape of each price segment, empty ones too."""
    names = [f"s{i + 1}" for i in range(len(cuts) + 1)]
    all_ = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("segment"))
    found = df.select(S.price_segment(actual, cuts).alias("segment"), (F.abs(actual - predicted) / actual).alias("e")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mape"))
    return all_.join(found, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"), "mape")


def lower_quantile(df: DataFrame, value: Column, alpha: float) -> DataFrame:
    """_offset: the value at place floor(alpha * (n - 1)) in order; null without values."""
    return quantiles.group_quantile(df.select(value.alias("_r")), [], "_r", alpha, lower=True).withColumnRenamed("q", "_offset")


def calibrated_floor(df: DataFrame, actual_log: str, raw_floor: str, cfg: Config = Config()) -> DataFrame:
    """floor_log: the raw floor shifted so that a share alpha of rows lies below it."""
    offset = lower_quantile(df, F.col(actual_log) - F.col(raw_floor), cfg.floor_alpha)
    return df.join(F.broadcast(offset), F.lit(True), "left").withColumn("floor_log", F.col(raw_floor) + F.col("_offset")).drop("_offset")  # one row


def with_support(df: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """support: training rows of the same keys, 0 if none."""
    counts = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"))
    return df.join(counts, keys, "left").withColumn("support", F.coalesce("support", F.lit(0)))


def below_floor(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """is_below and gap, where there is support and the object is not too old."""
    out = df.withColumn("gap", F.col("floor_log") - F.col("log_price"))
    return out.withColumn("is_below", F.coalesce((F.col("gap") > 0) & (F.col("support") >= cfg.floor_support) & (F.col("age") <= cfg.floor_max_age), F.lit(False)))


def feature_row(spark, as_of_year: int, **car) -> DataFrame:
    """One object's features; a mileage of 0 is known."""
    row = {c: car.get(c) for c in (*NUMERIC, *CATEGORICAL)}
    row["age"] = None if car.get("year") is None else float(as_of_year - car["year"] + 1)
    row["is_mileage_missing"] = float(car.get("mileage_km") is None)
    kinds = [*[f"{c} double" for c in NUMERIC], *[f"{c} string" for c in CATEGORICAL]]
    values = [None if row[c] is None else float(row[c]) for c in NUMERIC] + [row[c] or "NA" for c in CATEGORICAL]
    return spark.createDataFrame([tuple(values)], ", ".join(kinds))


def price_pipeline(numeric: list[str], categorical: list[str], label: str, max_depth: int = 5, max_iter: int = 30, max_bins: int = 128, seed: int = 42):
    """Indexed categories (unknown ones kept apart), medians for gaps, boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    check_features([*numeric, *categorical])
    index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep")
    fill = Imputer(inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric], strategy="median")
    gather = VectorAssembler(inputCols=[*[f"{c}_filled" for c in numeric], *[f"{c}_index" for c in categorical]], outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="predicted", maxDepth=max_depth, maxIter=max_iter, maxBins=max_bins, stepSize=0.1, seed=seed)
    return Pipeline(stages=[index, fill, gather, trees])


def dealt(df: DataFrame, id_col: str) -> DataFrame:
    """The rows, written once and dealt by their ids to parts of about PART_ROWS: a fit reads them many times and holds a part in one task, however few files they come from."""
    rows = working.written(df)
    return rows.repartition(max(1, math.ceil(rows.count() / PART_ROWS)), id_col)


def out_of_fold(df: DataFrame, pipeline, folds: int, keep: list[str]) -> DataFrame:
    """Predictions for each fold by a model fitted on the others."""
    out = None
    for f in range(folds):
        part = pipeline.fit(df.where(F.col("fold") != f)).transform(df.where(F.col("fold") == f)).select(*keep, "fold", "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def time_to_sell(closed: DataFrame, closed_at: str, posted_at: str) -> DataFrame:
    """days between posting and closing; negative ones are dropped."""
    return closed.withColumn("days", F.datediff(closed_at, posted_at)).where("days >= 0")


def coerce_features(df: DataFrame, numeric: tuple[str, ...] = NUMERIC, categorical: tuple[str, ...] = CATEGORICAL) -> DataFrame:
    """Features as a model takes them: what is no number is null, a category that is null or missing is 'NA'; columns it lacks are added."""
    number = {c: F.col(c).cast("string").try_cast("double") if c in df.columns else F.lit(None).cast("double") for c in numeric}
    name = {c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) if c in df.columns else F.lit("NA") for c in categorical}
    return df.withColumns(number | name)


def estimate(model, cars: DataFrame, predicted: str = "predicted") -> DataFrame:
    """`cars` with the estimate of a model of log prices; features may be missing (see coerce_features)."""
    ready = coerce_features(cars.withColumn("_car", F.struct(*cars.columns))).select(*NUMERIC, *CATEGORICAL, "_car")
    return model.transform(ready).select("_car.*", F.exp(predicted).alias("estimate"))
