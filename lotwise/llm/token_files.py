"""Token ids in binary files: fixed-width bit packing in blocks, with random access.

A file is a header, the offset of each block, the index of documents, and the
blocks.  An id takes the fewest bits that hold the vocabulary; block k holds ids
k * BLOCK to (k + 1) * BLOCK - 1 of the file, so any range of ids is read from
its blocks alone.  Numbers are little-endian.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import files, scratch, words
from lotwise.llm.bpe import gathered

MAGIC, HEADER = b"LWTOKEN1", struct.Struct("<8sIIQQQ")
BLOCK = 1 << 16

#: Bytes of text that are encoded at once.
CHUNK_BYTES = 8 << 20

#: Ids after which a task begins another file.
FILE_IDS = 8 << 20


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit i of id n is bit n * bits + i of the result."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little"), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.zeros((n, 32), np.uint8)
    spread[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").reshape(-1)


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int) -> bytes:
    """A whole file.  Null document ids are kept as the smallest 64-bit integer."""
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    names = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<i8")
    first = HEADER.size + 8 * (len(blocks) + 1) + names.nbytes + starts.nbytes
    offsets = first + np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<i8")
    return b"".join([HEADER.pack(MAGIC, bits, BLOCK, len(ids), len(names), len(blocks)), offsets.astype("<i8").tobytes(), names.tobytes(), starts.tobytes(), *blocks])


NULL_ID = -(1 << 63)


class TokenFile:
    """A file's index, and its ids by document or range; only the blocks that are asked for are read."""

    def __init__(self, source: pa.NativeFile):
        magic, self.bits, self.block, self.n_ids, n_docs, n_blocks = HEADER.unpack(source.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.source, sizes = source, [8 * (n_blocks + 1), 8 * n_docs, 8 * (n_docs + 1)]
        index = source.read_at(sum(sizes), HEADER.size)
        self.offsets, self.doc_ids, self.starts = (np.frombuffer(index, "<i8", n // 8, sum(sizes[:k])) for k, n in enumerate(sizes))

    def unpacked(self, b: int) -> np.ndarray:
        start, end = int(self.offsets[b]), int(self.offsets[b + 1])
        return unpack(self.source.read_at(end - start, start), min(self.block, self.n_ids - b * self.block), self.bits)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        return np.concatenate([self.unpacked(b) for b in range(first, last + 1)])[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def crcs(self) -> np.ndarray:
        """crc32 of each document's ids as 32-bit integers, with every block unpacked once."""
        out, at, have = np.zeros(len(self.doc_ids), np.int64), -1, np.zeros(0, np.uint32)
        for k, (start, end) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist())):
            crc = 0
            while start < end:
                if start // self.block != at:
                    at = start // self.block
                    have = self.unpacked(at).astype("<u4", copy=False)
                stop = min(end, (at + 1) * self.block)
                crc = zlib.crc32(have[start - at * self.block : stop - at * self.block], crc)
                start = stop
            out[k] = crc
        return out


#: A piece of plain letters with marks at its end: the vocabulary's pre-tokenizer parts the two.
LETTERS_MARKS = r"^(?P<letters>[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[.,;:!?]+)$"

#: Pieces that the library encodes at one call, and pieces kept with their ids.
AT_ONCE, KEPT_PIECES = 4096, 600_000


class Encoder:
    """The tokenizers library; each distinct piece between white space is encoded once and kept for a while in flat arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.place: dict[str, int] = {}
        self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in each piece, and all ids: one call, with a special token between pieces that hold none."""
        mark = next(iter(self.special), "")
        if mark:
            text = mark.join(pieces)
            if sum(map(text.count, self.special)) == len(pieces) - 1:
                ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == self.special[mark])
                return np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1, np.delete(ids, cuts)
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([len(f) for f in found], np.int64), np.array([i for f in found for i in f], np.uint32)

    def _looked_up(self, distinct: list[str]) -> np.ndarray:
        """Places of pieces in counts, with those added that are new."""
        get = self.place.get
        at = np.array([get(p, -1) for p in distinct], np.int64)
        if len(self.place) + np.count_nonzero(at < 0) > KEPT_PIECES and len(self.place):  # begin again with the pieces in use
            used = np.flatnonzero(at >= 0)
            starts = np.cumsum(self.counts) - self.counts
            self.flat, self.counts = self.flat[gathered(starts, self.counts, at[used])], self.counts[at[used]]
            at[used] = np.arange(len(used))
            self.place = {distinct[i]: k for k, i in enumerate(used.tolist())}
        new = np.flatnonzero(at < 0)
        parts = [self._encoded([distinct[i] for i in new[k : k + AT_ONCE].tolist()]) for k in range(0, len(new), AT_ONCE)]
        at[new] = len(self.counts) + np.arange(len(new))
        self.counts = np.concatenate([self.counts, *(c for c, _ in parts)])
        self.flat = np.concatenate([self.flat, *(f for _, f in parts)])
        self.place.update((distinct[i], int(at[i])) for i in new.tolist())
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the bounds of each."""
        texts = pc.fill_null(texts, "")
        if not any(pc.any(pc.match_substring(texts, s, ignore_case=True)).as_py() for s in self.special):
            texts = pc.ascii_lower(texts)  # as the vocabulary does; a special token in capitals is none
        distinct, codes, bounds = words.split(texts)
        parts = pc.extract_regex(distinct, LETTERS_MARKS)
        letters = pc.coalesce(pc.struct_field(parts, "letters"), distinct)
        marks = pc.struct_field(parts, "marks").drop_null()
        both = pa.chunked_array([letters, marks]).combine_chunks().dictionary_encode()
        if isinstance(both, pa.ChunkedArray):
            both = both.combine_chunks()
        at = self._looked_up(both.dictionary.to_pylist())[both.indices.to_numpy()]
        marked = parts.is_valid().to_numpy(zero_copy_only=False)
        first, second = at[: len(distinct)], np.zeros(len(distinct), np.int64)
        second[marked] = at[len(distinct) :]
        starts = np.cumsum(self.counts) - self.counts
        # the ids of each distinct piece, letters and marks together
        n = 1 + marked
        own = np.repeat(first, n)
        own[(np.cumsum(n) - 1)[marked]] = second[marked]
        flat = self.flat[gathered(starts, self.counts, own)]
        counts = self.counts[first] + np.where(marked, self.counts[second], 0)
        total = np.concatenate([[0], np.cumsum(counts[codes])])[bounds]
        return flat[gathered(np.cumsum(counts) - counts, counts, codes)], total


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, folder: str, path: str, vocabulary: int, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write their ids in ascending id order; (file, part, number, n_ids, n_docs) of each file.

    Documents are ranged by id over the tasks, so files follow each other in the
    order of (part, number).  `end_id` is appended to every document.  A null
    text is empty; null ids come first; rows that repeat an id follow each
    other, in the order of a hash of their texts.  A very long text is encoded
    whole; an empty table gives no file.  Only the id and the text are read;
    other columns may have any name.
    """
    bits = width(vocabulary)
    small = np.uint16 if bits <= 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.zeros(0, small)
            name = files.publish(folder, f"{part:06d}-{number:04d}.tokens", to_bytes(ids, names, lengths, bits))
            row = [name, part, number, len(ids), len(names)]
            for x in (held, names, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "part", "number", "n_ids", "n_docs"])

        for chunk in (c for b in batches for c in words.chunks(b, size=CHUNK_BYTES)):
            ids, total = encoder(path).encode(chunk.column(1))
            ids = ids.astype(small)
            if end_id is not None:
                ids, total = np.insert(ids, total[1:], end_id), total + np.arange(len(total))
            held.append(ids)
            names += chunk.column(0).to_pylist()
            lengths += np.diff(total).tolist()
            if sum(map(len, held)) >= FILE_IDS:
                yield flush()
                number += 1
        if names:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    return scratch.table(ordered.mapInArrow(run, "file string, part long, number long, n_ids long, n_docs long"), "manifest")


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all documents before."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.opened(name) as source:
                    f = TokenFile(source)
                    names = pa.array(f.doc_ids, pa.int64(), mask=f.doc_ids == NULL_ID)
                    yield pa.RecordBatch.from_arrays([names, pa.array(f.starts[:-1] + first), pa.array(np.diff(f.starts)), pa.array(f.crcs())], [id_col, "start", "n_tokens", "ids_crc32"])

    return placed.repartition(n, "file").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, vocabulary: int, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read(write(docs, scratch.folder(docs.sparkSession, "tokens"), path, vocabulary, end_id, id_col, text_col), id_col)
