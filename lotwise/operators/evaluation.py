"""What the price model and the detector are worth: shares, errors by bucket, floors for every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.config import Config
from lotwise.operators import folded, pricing
from lotwise.operators.rules import scrub_mileage
from lotwise.sources import working


def suspicion_share(df: DataFrame, reasons: Column) -> DataFrame:
    """n, how many rows have a reason, and their share (null for no rows)."""
    some = F.coalesce(reasons != "", F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(some).alias("n_suspicious"), F.avg(some.cast("double")).alias("share"))


def training_rows(df: DataFrame, suspicious: Column, price: str = "price_tenge", mileage: str = "mileage_km") -> DataFrame:
    """Rows that a price model may learn from: a known positive price and no suspicion; junk mileages are nulls. Adds log_price."""
    rows = df.where((F.col(price) > 0) & ~F.coalesce(suspicious, F.lit(False)))
    return scrub_mileage(rows, mileage).drop("is_junk").withColumn("log_price", F.ln(price))


def error_by(df: DataFrame, key: str, actual: Column, predicted: Column) -> DataFrame:
    """n and mape of each value of `key`, a null one too."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(actual - predicted) / actual).alias("mape"))


def fold_metrics(scored: dict[str, DataFrame], actual: Column, predicted: Column) -> DataFrame:
    """(method, fold, n, mape, mae, r2_log): the metrics of each fold and, with a null fold, of all rows, in one pass over each frame."""
    out = []
    for name, df in scored.items():
        rows = df.select("fold", actual.cast("double").alias("y"), predicted.cast("double").alias("p")).withColumns({"ly": F.ln("y"), "lp": F.ln("p")})
        off = F.abs(F.col("y") - F.col("p"))
        sums = rows.rollup("fold").agg(
            F.count(F.lit(1)).alias("n"), F.avg(off / F.col("y")).alias("mape"), F.avg(off).alias("mae"), F.sum((F.col("ly") - F.col("lp")) ** 2).alias("_e"),
            (F.sum(F.col("ly") * F.col("ly")) - F.sum("ly") * F.sum("ly") / F.count("ly")).alias("_d"),
        )
        out.append(sums.select(F.lit(name).alias("method"), "fold", "n", "mape", "mae", (1 - F.try_divide("_e", "_d")).alias("r2_log")))
    return reduce(DataFrame.unionByName, out)


def share_below(df: DataFrame, value: Column, floor: Column) -> DataFrame:
    """n rows with both, and the share of them below the floor."""
    known = df.where(value.isNotNull() & floor.isNotNull())
    return known.agg(F.count(F.lit(1)).alias("n"), F.avg((value < floor).cast("double")).alias("share"))


def floor_for_all(df: DataFrame, value: str, tiers: list[list[str]], suspicious: Column, folds: int, stat, cfg: Config = Config()) -> DataFrame:
    """floor_log of every row of a frame with a fold; suspicious rows are never learned from.

    Clean rows get the statistic of the other folds' clean rows, suspicious ones
    that of all clean rows.  The shift that leaves a share alpha below the floor
    is taken from the clean rows alone.
    """
    marked = df.withColumn("_suspicious", F.coalesce(suspicious, F.lit(False))).withColumn("fold", F.when(F.col("_suspicious"), -1).otherwise(F.col("fold")))
    out = pricing.hierarchical(marked, value, tiers, [*range(folds), -1], stat, learn=~F.col("_suspicious"))
    offset = pricing.lower_quantile(out.where(~F.col("_suspicious")), F.col(value) - F.col("predicted"), cfg.floor_alpha)
    return out.join(F.broadcast(offset), F.lit(True), "left").withColumn("floor_log", F.col("predicted") + F.col("_offset")).drop("_offset", "_suspicious")  # one row


def evaluate_temporal(df: DataFrame, ts: str, id_col: str, group: str, label: str, tiers: list[list[str]], pipeline=None, least: tuple[int, int, int] = (100, 50, 20)) -> DataFrame:
    """(method, train_rows, test_rows, train_until, test_from, n, mape, mae, r2_log): the hierarchical median, and `pipeline` if given, on the newest fifth.

    `label` is a log price.  Without enough rows that have a time, or too few to
    learn from or to test on (the three of `least`), or with one time only, there are no rows.
    `df` and its parts are written once, as every step reads them again.
    """
    known = working.written(df.where(F.col(label).isNotNull()))
    parts = working.written(pricing.temporal_holdout(known, ts, id_col, group))
    train, test = F.col("part") == "train", F.col("part") == "test"
    facts = parts.agg(
        F.count(ts).alias("_timed"), F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"),
        F.max(F.when(train, F.col(ts))).alias("train_until"), F.min(F.when(test, F.col(ts))).alias("test_from"),
    )
    enough = (F.col("_timed") >= least[0]) & (F.col("_first") < F.col("_last")) & (F.col("train_rows") >= least[1]) & (F.col("test_rows") >= least[2])
    facts = facts.where(enough).select("train_rows", "test_rows", "train_until", "test_from")
    folded = parts.where(train | test).withColumn("fold", test.cast("int"))
    scored = {"baseline": pricing.hierarchical(folded, label, tiers, [0, 1], learn=F.col("fold") == 0).where("fold = 1")}
    if pipeline is not None and folded.where("fold = 0").limit(1).count():
        scored["model"] = pipeline.fit(pricing.dealt(folded.where("fold = 0"), id_col)).transform(folded.where("fold = 1"))
    rows = [pricing.regression_metrics(x, F.exp(label), F.exp("predicted")).select(F.lit(name).alias("method"), "*") for name, x in scored.items()]
    return facts.join(F.broadcast(reduce(DataFrame.unionByName, rows)), how="cross").select("method", "train_rows", "test_rows", "train_until", "test_from", "n", "mape", "mae", "r2_log")  # two rows at most


def importances(model, spark: SparkSession, numeric: list[str], categorical: list[str], n: int = 12) -> DataFrame:
    """(feature, importance) of the n features that a fitted price pipeline uses most."""
    weights = model.stages[-1].featureImportances.toArray()  # one number for each feature
    rows = sorted(zip([*numeric, *categorical], map(float, weights)), key=lambda x: (-x[1], x[0]))[:n]
    return spark.createDataFrame(rows, "feature string, importance double")


def learning_curve(df: DataFrame, id_col: str, group: str, numeric: list[str], categorical: list[str], label: str, folds: int, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), **how) -> DataFrame:
    """(share, n, mape) of out-of-fold estimates as more whole groups are learned from; `df` has a fold and unique ids, `label` is a log price.

    A step knows no row outside its share, neither to learn from nor to be
    tested on.  The models of all shares and folds are grown together, with the
    jobs of one, and a row is kept once for all of them (see folded.out_of_fold, which takes `how`).  Rows without a label
    do not count; a share without rows, or with rows of one fold only, has no mape.
    """
    order = sorted(range(len(shares)), key=lambda i: shares[i])
    rows = df.where(F.col(label).isNotNull()).select(id_col, "fold", label, *numeric, *categorical, pricing.group_point(group).alias("_point"))
    rows = working.written(rows)  # lest groups are made anew wherever their point is asked for
    first = reduce(Column.__add__, [F.when(F.col("_point") < int(shares[i] * 2**32), 0).otherwise(1) for i in order])
    scored = folded.out_of_fold(rows, id_col, numeric, categorical, label, folds, F.when(first < len(shares), first), len(shares), **how)
    by_step = scored.groupBy(F.floor(F.col("model") / folds).cast("int").alias("_step")).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.abs(F.exp("y") - F.exp("predicted")) / F.exp("y")).alias("mape"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("_at"), F.lit(float(shares[i])).alias("share")) for k, i in enumerate(order)])).alias("_s")).select("_s.*")
    return every.join(by_step, F.col("_at") == F.col("_step"), "left").select("share", F.coalesce("_n", F.lit(0)).alias("n"), "mape")


def curve_gains(curve: DataFrame, least: float = 0.5) -> DataFrame:
    """first_gain and last_gain in points of mape of a learning curve's steps, and whether the last one is too small to go on."""
    points = F.array_sort(F.collect_list(F.struct("share", "mape")))  # a row for each share
    at = lambda i: F.try_element_at("_p", F.lit(i))["mape"] * 100
    out = curve.agg(points.alias("_p")).select((at(1) - at(2)).alias("first_gain"), (at(-2) - at(-1)).alias("last_gain"))
    return out.withColumn("is_plateau", F.abs("last_gain") < least)


def residual_histogram(df: DataFrame, actual_log: str, predicted_log: str, bins: int = 60) -> DataFrame:
    """(bin from 1, low, n): residuals in bins of equal width from the least to the greatest, which the last bin holds."""
    rows = df.select((F.col(actual_log) - F.col(predicted_log)).alias("_x")).where("_x is not null")
    rows = rows.join(F.broadcast(rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))), how="cross")  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.coalesce(F.floor((F.col("_x") - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.groupBy((at + 1).alias("bin")).agg(F.first(F.col("_lo") + at * width).alias("low"), F.count(F.lit(1)).alias("n"))
