"""Exact quantiles of groups of any size: a sketch brackets the place, and only the values between are put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.sources import working

#: Plans that read more bytes from their sources are bracketed; for others no group is too large for one task.
MANY_BYTES = 64 << 20
#: Where the plan does not know the bytes, the same in rows.
MANY_ROWS = 1_000_000
#: A group of at most so many rows is ordered as a whole.
WHOLE_GROUP = 100_000
#: Half the width of the bracket as a share of the group, and the sketch's accuracy, which must be well over its inverse.
REACH, ACCURACY = 0.0005, 10_000


def is_large(df: DataFrame) -> bool:
    """Whether the sources of a plan hold much, by the statistics of the plan; rows are counted only where a source gives none."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    known = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if max(known, default=0) < 1 << 60:
        return sum(known) > MANY_BYTES
    return df.select(F.lit(1)).limit(MANY_ROWS + 1).count() > MANY_ROWS


def _matched(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return same


def _placed(rows: DataFrame, bounds: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, _n, _a, _b): the values at the places around the share of each group in `bounds`.

    -Infinity where a place lies below the bracket, null where it lies above.
    """
    met = rows.join(bounds if keys else F.broadcast(bounds), _matched(keys)).where("_x <= _hi")  # without keys, one row
    counts = met.groupBy(*keys, "_n", F.when(F.col("_x") < F.col("_lo"), float("-inf")).otherwise(F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")))
    place = (F.col("_n") - 1) * F.lit(share)
    at = lambda p: F.min(F.when(F.col("_upto") > p, F.col("_v")))
    return counts.groupBy(*keys).agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"), F.first("_n").alias("_n"))


def group_quantile(df: DataFrame, keys: list[str], value: str, share: float, large: bool | None = None, lower: bool = False, whole: int | None = None, reach: float = REACH) -> DataFrame:
    """(keys, q) of groups with values: interpolated, or the value at the place below.  Null keys are a group.

    In large tables, groups of over `whole` rows are bracketed by a sketch.  The
    counts at both ends of a bracket tell whether the places lie inside; the
    groups that a bracket missed are ordered again without one.  This writes a
    row for each group while the query is built.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    large = is_large(rows) if large is None else large
    if not lower and not large:
        return rows.groupBy(*keys).agg(F.percentile("_x", F.lit(share)).alias("q"))
    sketch = [F.percentile_approx("_x", [min(max(share + end, 0.0), 1.0) for end in (-reach, reach)], ACCURACY).alias("_ends")] if large else []
    bounds = rows.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), *sketch)
    if large:
        many = F.col("_n") > (WHOLE_GROUP if whole is None else whole)
        bounds = bounds.withColumns({"_lo": F.when(many, F.col("_ends")[0]).otherwise(F.col("_lo")), "_hi": F.when(many, F.col("_ends")[1]).otherwise(F.col("_hi"))}).drop("_ends")
        bounds = working.written(bounds)
    found = _placed(rows, bounds, keys, share)
    if large:
        found = working.written(found)
        inside = F.coalesce((F.col("_a") > float("-inf")) & F.col("_b").isNotNull(), F.lit(False))
        missed = found.where(~inside)
        if not missed.isEmpty():
            again = bounds.join(missed.select(*keys, F.lit(True).alias("_again")), _matched(keys), "left_semi") if keys else bounds
            wide = again.withColumns({"_lo": F.lit(float("-inf")), "_hi": F.lit(float("inf"))})
            found = found.where(inside).unionByName(_placed(rows, wide, keys, share))
    place = (F.col("_n") - 1) * F.lit(share)
    between = F.when(F.floor(place) == F.ceil(place), F.col("_a")).otherwise((F.ceil(place) - place) * F.col("_a") + (place - F.floor(place)) * F.col("_b"))
    return found.select(*keys, (F.col("_a") if lower else between).alias("q"))
