"""Hashes of picture files written from vectors, against a plain hash of each."""

import math
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lotwise.functions import phash
from lotwise.operators import groups
from lotwise.sources import pictures


def png(x):
    """A PNG file of height x width x 3 or height x width bytes."""
    kind = 2 if x.ndim == 3 else 0

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    raw = b"".join(b"\0" + row.tobytes() for row in x)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def brute(x):
    """Cosine transform of the averaged picture, frequency by frequency."""
    g = x.astype(float) if x.ndim == 2 else x[:, :, 0] * 0.299 + x[:, :, 1] * 0.587 + x[:, :, 2] * 0.114
    h, w = g.shape
    small = np.zeros((32, 32))
    fine = np.repeat(np.repeat(g, 32, 0), 32, 1)
    for i in range(32):
        for j in range(32):
            small[i, j] = fine[i * h : (i + 1) * h, j * w : (j + 1) * w].mean()
    low = [sum(small[a, b] * math.cos(math.pi * i * (2 * a + 1) / 64) * math.cos(math.pi * j * (2 * b + 1) / 64) for a in range(32) for b in range(32)) for i in range(8) for j in range(8)]
    middle = float(np.median(low))
    return f"{int(''.join('01'[int(v > middle)] for v in low), 2):016x}"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Pictures of three sizes, in grey and in colours, a copy and a file that is no picture."""
    path = tmp_path_factory.mktemp("pictures")
    vectors = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").column("embedding").to_pylist()[:12]
    drawn = {}
    for k, v in enumerate(vectors):
        v = np.interp(np.array(v), (min(v), max(v)), (0, 255))
        side = (16, 40, 64)[k % 3]
        x = np.outer(v, v[::-1])[: side if side < len(v) else None] / 255
        x = np.resize(x, (side, side + 5)).astype(np.uint8)
        drawn[f"p{k}.png"] = np.stack([x, np.roll(x, 3, 0), 255 - x], 2) if k % 2 else x
    drawn["copy.png"] = drawn["p1.png"]
    for name, x in drawn.items():
        (path / name).write_bytes(png(x))
    (path / "broken.png").write_bytes(b"no picture")
    return path, drawn


def test_hashes_of_files(spark, folder):
    path, drawn = folder
    got = {r.origin.rsplit("/", 1)[1]: r for r in pictures.hashed(pictures.read(spark, str(path))).collect()}
    assert {n: r.phash for n, r in got.items()} == {n: brute(x) for n, x in drawn.items()}
    assert all(r.bits % 2**64 == int(r.phash, 16) for r in got.values()) and got["copy.png"].bits == got["p1.png"].bits


def test_groups_of_files(spark, folder):
    path, _ = folder
    rows = pictures.hashed(pictures.read(spark, str(path))).select(F.element_at(F.split("origin", "/"), -1).alias("name"), "bits")
    ids = rows.select(F.when(F.col("name") == "copy.png", 100).otherwise(F.regexp_extract("name", r"\d+", 0).try_cast("int")).alias("ad_id"), "bits")
    got = {r.ad_id: r for r in groups.hash_groups(ids, 0).collect()}
    assert got[100].representative == 1 and got[100].n_links == 1 and got[0].n_links == 0


def test_odd_pixels(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0] * 5), (3, [float(i % 7) for i in range(1024)]), (4, [])], "i int, x array<double>")
    got = {r.i: r.h for r in df.select("i", phash.phash(F.col("x")).alias("h")).collect()}
    assert got[1] is got[2] is got[4] is None and got[3] == brute(np.array([i % 7 for i in range(1024)], float).reshape(32, 32))


@pytest.mark.parametrize("size", [1, 5, 31, 32, 33, 100])
def test_averages(size):
    m, x = pictures.averages(size, 32), np.arange(size) ** 2.0
    assert np.allclose(m.sum(1), 1) and np.allclose(m @ x, np.repeat(x, 32).reshape(32, size).mean(1))
