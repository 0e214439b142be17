"""Columnar splitting of texts into words, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are split at once; a batch of long documents goes in several parts.
CHUNK_BYTES = 4 << 20


def chunks(batch: pa.RecordBatch, column: int = 1, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each, at least one row; memory freed by one is given back before the next."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word codes of all texts one after another, and each text's bounds among them.

    Words are what lies between ASCII white space; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.list_flatten(lists).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        keep = codes != empty
        bounds = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[bounds]
        codes = codes[keep]
    return coded.dictionary, codes, bounds


def hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
