"""WARC archives in seekable Zstandard files.

Records go in independent frames of about FRAME_BYTES.  Two skippable frames end
the file: an index of record ids (frame, offset and length within it) and the
seek table of the Zstandard seekable format, from which any frame is found.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import files, scratch

FRAME_BYTES, FILE_BYTES = 256 << 10, 48 << 20
INDEX_FRAME, SEEK_FRAME, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = np.dtype([("id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
NULL_ID = -(1 << 63)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = {
        "WARC-Type": "revisit" if is_revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": PROFILE if is_revisit else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if is_revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None), b"\r\n", block, b"\r\n\r\n"])


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda x: dict(line.split(": ", 1) for line in x.decode().split("\r\n")[1:])
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


class Bundle:
    """Frames, index and seek table of a file under way."""

    def __init__(self):
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.at = self.written = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.entries.append((NULL_ID if page_id is None else page_id, len(self.frames), self.at, len(raw)))
        self.open.append(raw)
        self.at += len(raw)
        if self.at >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = zstandard.ZstdCompressor(level=3).compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.at))
            self.written += len(frame)
            self.open, self.at = [], 0

    def to_bytes(self) -> bytes:
        self.close_frame()
        index = np.array(self.entries, ENTRY).tobytes()
        table = b"".join(struct.pack("<II", *s) for s in [*self.sizes, (len(index) + 8, 0)]) + struct.pack("<IBI", len(self.sizes) + 1, 0, SEEK_MAGIC)
        skippable = lambda magic, x: struct.pack("<II", magic, len(x)) + x
        return b"".join([*self.frames, skippable(INDEX_FRAME, index), skippable(SEEK_FRAME, table)])


class Archive:
    """Records of a file by id, or all of them; what is read is the seek table, the index, and a frame at a time."""

    def __init__(self, source: pa.NativeFile):
        size = source.size()
        n, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        table = np.frombuffer(source.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(n, 2)
        self.source, self.starts = source, np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.sizes = table[:, 1]
        at = int(self.starts[n - 1]) + 8
        self.index = np.frombuffer(source.read_at(int(self.starts[n]) - at, at), ENTRY)
        self.by_id: dict[int, int] | None = None

    def frame(self, k: int) -> bytes:
        start, end = int(self.starts[k]), int(self.starts[k + 1])
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(end - start, start), max_output_size=int(self.sizes[k]))

    def record(self, page_id: int) -> bytes:
        if self.by_id is None:
            self.by_id = {int(x): i for i, x in reversed([*enumerate(self.index["id"])])}
        e = self.index[self.by_id[page_id]]
        return self.frame(int(e["frame"]))[e["offset"] : e["offset"] + e["length"]]

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        at, raw = -1, b""
        for e in self.index:
            if e["frame"] != at:
                at, raw = int(e["frame"]), self.frame(int(e["frame"]))
            yield None if e["id"] == NULL_ID else int(e["id"]), raw[e["offset"] : e["offset"] + e["length"]]


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row; (file, n_records) of each file.

    Of rows with equal payloads of at least `least_bytes` bytes, the one of the
    smallest id is a response and the others revisits of it; smaller payloads
    are all responses.  A null payload is empty.  Equality is of the SHA-1
    digest and length.  A row that repeats the smallest id is a response too; a
    null id is a revisit of any other.  A very long payload is a frame of its
    own; a null url is left out of the record; an empty table gives no file.
    Other columns are not read and may have any name.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    first = rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null")
    first = scratch.table(first.select("digest", "n", "first"), "first")
    joined = rows.join(first, ["digest", "n"], "left").select("id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def flush() -> pa.RecordBatch:
            name = files.publish(folder, f"{part:06d}-{number:04d}.warc.zst", bundle.to_bytes())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(bundle.entries)], pa.int64())], ["file", "n_records"])

        for batch in batches:
            for page_id, url, html, of in zip(*(batch.column(i) for i in range(4))):
                page_id, of = page_id.as_py(), of.as_py()
                revisit = of is not None and of != page_id
                bundle.add(page_id, record(page_id, url.as_py(), html.as_buffer().to_pybytes(), of, revisit, date))
                if bundle.written >= FILE_BYTES:
                    yield flush()
                    number, bundle = number + 1, Bundle()
        if bundle.entries:
            yield flush()

    return scratch.table(joined.mapInArrow(run, "file string, n_records long"), "archives")


def read(archives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Every record of the archives: (id, url, payload_bytes, payload_digest, record_type, refers_to, html).

    payload_bytes and payload_digest are of the full payload, which a revisit does not repeat (its html is null).
    """
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [id_col, "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            rows, held = [], 0
            for page_id, raw in Archive(source := files.opened(name)):
                warc, http, payload = parse(raw)
                revisit, of = warc["WARC-Type"] == "revisit", warc.get("WARC-Refers-To")
                digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{name}: the payload of {page_id} differs from its digest")
                rows.append((page_id, warc.get("WARC-Target-URI"), int(http["Content-Length"]), digest, warc["WARC-Type"], int(of[len("<urn:page:") : -1]) if of else None, None if revisit else payload.decode()))
                held += len(payload)
                if held >= 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            source.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return archives.select("file").repartition(n, "file").mapInArrow(run, f"`{id_col}` long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
