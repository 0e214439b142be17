"""Categories as numbers: ordered target statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the permutation; a category's rows are ordered within a part only, so none is too many for one task.
BLOCKS = 256


def ordered_statistics(df: DataFrame, category: str, label: str, id_col: str, out: str, keys: tuple[str, ...] = (), last: Column | None = None, weight: float = 1.0, blocks: int = BLOCKS, seed: int = 0, source: DataFrame | None = None) -> DataFrame:
    """Adds `out`: the mean label of the rows of the same category (and `keys`) that come earlier in a fixed permutation, with a prior.

    (sum of earlier labels + weight * prior) / (earlier labels + weight), where
    the prior is the mean label of the same `keys`, 0 without any.  The permutation is by
    the MD5 of the id; ties of ids share a place and do not see each other.
    Rows where `last` holds come after all others and are never learned from.
    Rows without a label are encoded but not learned from; a null category is a
    category.

    The permutation is cut into `blocks`.  Sums of a category's blocks are
    counted with a combine on the map side and added up over the blocks; only
    the rows of one block and category are put in order together.  `source` is
    `df` before other categories were encoded: sums read it, lest they encode them again.
    """
    perm = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(id_col).cast("string")))
    block = F.floor(F.conv(F.substring(perm, 1, 8), 16, 10).cast("long") * blocks / 2**32).cast("int")
    at_end = F.lit(False) if last is None else F.coalesce(last, F.lit(False))
    marks = {"_perm": perm, "_block": F.when(at_end, blocks).otherwise(block), "_y": F.when(~at_end, F.col(label).cast("double"))}
    source = df if source is None else source
    rows = df.withColumns(marks)
    same = [*keys, category]
    sums = source.withColumns(marks).groupBy(*[F.col(k).alias(f"_k_{k}") for k in same], F.col("_block").alias("_kb")).agg(F.sum("_y").alias("_bs"), F.count("_y").alias("_bn"))
    before = Window.partitionBy(*[f"_k_{k}" for k in same]).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sums = sums.withColumns({"_s0": F.sum("_bs").over(before), "_n0": F.sum("_bn").over(before)}).drop("_bs", "_bn")
    inner = Window.partitionBy(*same, "_block").orderBy("_perm").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = Window.partitionBy(*same, "_block", "_perm")
    learned = F.col("_block") < blocks
    rows = rows.withColumns({"_s1": F.when(learned, F.coalesce(F.sum("_y").over(inner), F.lit(0.0)) - F.coalesce(F.sum("_y").over(tied), F.lit(0.0))), "_n1": F.when(learned, F.count("_y").over(inner) - F.count("_y").over(tied))})
    meet = F.col("_block") == F.col("_kb")
    for k in same:
        meet = meet & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = rows.join(sums, meet, "left")
    prior = source.where(~at_end).groupBy(*[F.col(k).alias(f"_p_{k}") for k in keys]).agg(F.avg(F.col(label).cast("double")).alias("_prior"))
    if keys:
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
        rows = rows.join(prior, known, "left")
    else:
        rows = rows.join(F.broadcast(prior), how="cross")  # one row
    total = lambda a, b: F.coalesce(F.col(a), F.lit(0.0)) + F.coalesce(F.col(b), F.lit(0.0))
    value = (total("_s0", "_s1") + weight * F.coalesce("_prior", F.lit(0.0))) / (total("_n0", "_n1") + weight)
    return rows.withColumn(out, value).select(*df.columns, out)


def all_statistics(df: DataFrame, categories: list[str], label: str, id_col: str, weight: float = 1.0) -> DataFrame:
    """<category>_stat of every category, apart for each `for_fold`; rows with `held` are never learned from."""
    rows = df
    for c in categories:
        rows = ordered_statistics(rows, c, label, id_col, f"{c}_stat", keys=("for_fold",), last=F.col("held"), weight=weight, source=df)
    return rows


def for_each_fold(df: DataFrame, categories: list[str], label: str, id_col: str, folds: int, weight: float = 1.0) -> DataFrame:
    """Each row once for every fold's model, with `for_fold` (the fold held out), `held` (the model is not to learn from the row) and <category>_stat.

    Statistics of a model know the labels of other folds only: earlier ones for
    the rows it learns from, all of them for those held out.
    """
    rows = df.withColumn("for_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("held", F.col("fold") == F.col("for_fold"))
    return all_statistics(rows, categories, label, id_col, weight)
