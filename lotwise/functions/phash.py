"""Perceptual hashes of pictures given as grey values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of the grey picture, and of the square of low frequencies that makes the hash.
SIDE, LOW = 32, 8


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def hashes(grey: np.ndarray) -> np.ndarray:
    """The hashes of n pictures of SIDE x SIDE grey values: two matrix products over the whole batch, then a median each."""
    basis = _cosines(SIDE)[:LOW]
    low = np.einsum("ij,njk,lk->nil", basis, grey, basis, optimize=True).reshape(len(grey), LOW * LOW)
    bits = low > np.median(low, axis=1, keepdims=True) if len(low) else low.astype(bool)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1)


def phash(pixels: Column) -> Column:
    """16 hexadecimal digits for SIDE x SIDE grey values, row by row: the low frequencies above their median; null for another size."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(batch), SIDE * SIDE), False)
        grey = pc.list_flatten(batch.filter(fits)).to_numpy(zero_copy_only=False).astype(float).reshape(-1, SIDE, SIDE)
        found = pa.array([f"{int(h):016x}" for h in hashes(grey)], pa.string())
        at = np.cumsum(fits.to_numpy(zero_copy_only=False)) - 1
        return found.take(pa.array(at, mask=~fits.to_numpy(zero_copy_only=False)))

    return run(pixels)
