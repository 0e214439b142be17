"""Review by people: strata of a labelling queue, and what their verdicts say of the detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.config import Config
from lotwise.sources import working


def with_strata(df: DataFrame, rule: Column, residual: Column) -> DataFrame:
    return df.withColumn("sampling_stratum", F.when(rule, "rule_positive").when(residual, "residual_candidate").otherwise("random_control"))


def labelling_queue(df: DataFrame, verdicts: DataFrame, id_col: str, rule: Column, residual: Column, cfg: Config = Config()) -> DataFrame:
    """Rows to review: all flagged ones, all residual candidates, and a hash sample of the rest.

    Populations count every row, also those with a verdict; these are then left
    out.  stratum_sample_size counts what is queued.
    """
    done = verdicts.select(F.col(id_col).alias("_done")).distinct()
    rows = with_strata(df, F.coalesce(rule, F.lit(False)), F.coalesce(residual, F.lit(False)))
    rows = working.written(rows.join(done, F.col(id_col) == F.col("_done"), "left").withColumn("_done", F.col("_done").isNotNull()))
    control = F.col("sampling_stratum") == "random_control"
    open_ = F.count_if(~F.col("_done"))
    sizes = rows.groupBy("sampling_stratum").agg(F.count(F.lit(1)).alias("stratum_population"), F.when(F.col("sampling_stratum") == "random_control", F.least(open_, F.lit(cfg.control_sample))).otherwise(open_).alias("stratum_sample_size"))
    waiting = rows.where(~F.col("_done")).drop("_done")
    queue = waiting.where(~control).unionByName(waiting.where(control).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(cfg.control_sample))
    return queue.join(F.broadcast(sizes), "sampling_stratum")  # three rows


def confusion(df: DataFrame, flagged: Column, fraud: Column) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(n) for n, c in (("tp", flagged & fraud), ("fp", flagged & ~fraud), ("fn", ~flagged & fraud), ("tn", ~flagged & ~fraud))])


def weighted_confusion(df: DataFrame, flagged: Column, fraud: Column, population: Column, sample: Column) -> DataFrame:
    """Weights are population over sample; all null if any row lacks them or its sample is not positive."""
    bad = population.isNull() | sample.isNull() | F.coalesce(sample <= 0, F.lit(True))
    ok = ~F.coalesce(F.bool_or(bad), F.lit(True))
    weight = population / F.nullif(sample.cast("double"), F.lit(0.0))
    cells = (("tp", flagged & fraud), ("fp", flagged & ~fraud), ("fn", ~flagged & fraud), ("tn", ~flagged & ~fraud))
    return df.agg(*[F.when(ok, F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0))).alias(n) for n, c in cells])


def precision_recall(cells: DataFrame) -> DataFrame:
    """From tp, fp, fn: null where nothing was flagged or nothing was fraud; f1 is 0 if both are 0."""
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    out = cells.withColumns({"precision": p, "recall": r})
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total == 0, 0.0).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), total)))


def rule_precision(df: DataFrame, reasons: Column, fraud: Column) -> DataFrame:
    """For each reason of labelled rows: how many, and the share that is fraud."""
    rows = df.select(F.explode(F.array_remove(F.split(reasons, "[|]"), "")).alias("reason"), fraud.cast("double").alias("f"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("precision"))


def reason_counts(df: DataFrame, reasons: Column) -> DataFrame:
    return df.select(F.explode(F.array_remove(F.split(reasons, "[|]"), "")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def whole_counts(df: DataFrame, flags: Column) -> DataFrame:
    """Counts of the lists as they are, not of their parts."""
    return df.select(flags.alias("flags")).where("flags <> ''").groupBy("flags").agg(F.count(F.lit(1)).alias("n"))
