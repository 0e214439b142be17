"""An isolation forest: trees grown on bounded samples, rows scored where they are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators import quantiles
from lotwise.sources import working


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if depth == 0 or not len(spread):
        return (len(x),)
    c = int(rng.choice(spread))
    at = float(rng.uniform(x[:, c].min(), x[:, c].max()))
    left = x[:, c] < at
    return c, at, _grow(x[left], depth - 1, rng), _grow(x[~left], depth - 1, rng)


def _mean_path(n: np.ndarray | int):
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _depths(tree: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + float(_mean_path(tree[0])))
    c, at, left, right = tree
    out, go = np.empty(len(x)), x[:, c] < at
    out[go], out[~go] = _depths(left, x[go], depth + 1), _depths(right, x[~go], depth + 1)
    return out


def isolation_scores(df: DataFrame, id_col: str, features: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.02, seed: int = 42) -> DataFrame:
    """(id, score, is_outlier): gaps are filled with medians; at most trees * sample rows come to the driver."""
    medians = [quantiles.group_quantile(df, [], c, 0.5).withColumnRenamed("q", c) for c in features] if quantiles.is_large(df) else [df.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in features])]
    medians = reduce(lambda a, b: a.join(b, how="full", on=F.lit(True)), medians)  # one row each
    known = df.join(F.broadcast(medians.withColumnsRenamed({c: f"_m_{c}" for c in features})), how="cross")  # one row
    rows = known.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)).alias(c) for c in features])
    picked = rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(trees * sample).select(*features).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    size = min(sample, len(picked))
    grown = [_grow(picked[rng.choice(len(picked), size, replace=False)], int(np.ceil(np.log2(max(size, 2)))), rng) for _ in range(trees if size else 0)]
    shared = df.sparkSession.sparkContext.broadcast(grown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(features))], 1)
            path = np.mean([_depths(t, x) for t in shared.value], 0) if shared.value else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2 ** (-path / max(float(_mean_path(size)), 1e-9)))], [id_col, "score"])

    scored = working.written(rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double"))
    limit = scored.agg(F.expr(f"percentile_approx(score, {1 - contamination}, 100000)").alias("_limit"))
    return scored.join(F.broadcast(limit), how="cross").select(id_col, "score", (F.col("score") > F.col("_limit")).alias("is_outlier"))  # one row
