"""Pictures in files: decoded by Spark, scaled to small grey squares, hashed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import phash

# fixed values: how much red, green and blue add to grey
RED, GREEN, BLUE = 0.299, 0.587, 0.114


def read(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, channels, data) of the picture files in a folder; those that cannot be decoded are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def averages(size: int, side: int) -> np.ndarray:
    """A side x size matrix whose rows average equal parts of a line of `size` values; a part may end within a value."""
    edges = np.arange(side + 1) * size / side
    low, high = np.arange(size), np.arange(1, size + 1)
    shared = np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low)
    return np.maximum(shared, 0) / (size / side)


def grey(data: np.ndarray, height: int, width: int, channels: int) -> np.ndarray:
    """Grey values of a decoded picture, whose channels come in the order blue, green, red[, alpha]."""
    x = data.reshape(height, width, channels).astype(float)
    return x[:, :, 0] if channels == 1 else x[:, :, 0] * BLUE + x[:, :, 1] * GREEN + x[:, :, 2] * RED


def hashed(pictures: DataFrame) -> DataFrame:
    """(origin, phash, bits) of decoded pictures: the perceptual hash as 16 hexadecimal digits and as a signed number.

    Pictures of one size in a batch are scaled and transformed together by
    matrix products.  A picture without pixels has no hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))))
            digits: list[str | None] = [None] * batch.num_rows
            for shape in {s for s in shapes if None not in s and min(s) > 0}:
                at = [i for i, s in enumerate(shapes) if s == shape]
                x = np.stack([grey(np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8), *shape) for i in at])
                rows, columns = (averages(n, phash.SIDE) for n in shape[:2])
                small = np.einsum("ij,njk,lk->nil", rows, x, columns, optimize=True)
                for i, h in zip(at, phash.hashes(small)):
                    digits[i] = f"{int(h):016x}"
            bits = pa.array([None if d is None else int(d, 16) - (int(d, 16) >> 63 << 64) for d in digits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digits, pa.string()), bits], ["origin", "phash", "bits"])

    return pictures.select("origin", "height", "width", "channels", "data").mapInArrow(run, "origin string, phash string, bits long")
