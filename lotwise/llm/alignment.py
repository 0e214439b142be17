"""Links between the tokens of two tokenisers over the same bytes, by products of sparse incidence matrices.

A row of a token-byte matrix has an entry for each byte of the token.  The
product of A's matrix with the transpose of B's, row by row after Gustavson,
has an entry for each pair of tokens that overlap, its value the bytes they
share.  Offsets where tokens of both end cut them into groups; the product of
the token-group matrices has an entry for each pair that shares a group.
Matrices are kept as compressed sparse rows, built by hand.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import scratch, segments, words

#: Bytes of text whose documents share one matrix.
CHUNK_BYTES = 2 << 20
#: Entries that a product expands at once, and bytes of segments whose tokens are laid over bytes at once.
BLOCK = 1 << 18


class Csr:
    """Compressed sparse rows: the entries of row i are columns[ptr[i]:ptr[i + 1]] with their values."""

    def __init__(self, ptr: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.ptr, self.columns, self.values, self.width = ptr, columns, values, width

    @staticmethod
    def of_sizes(sizes: np.ndarray) -> Csr:
        """Row i has sizes[i] ones, in the columns after those of row i - 1: tokens over bytes."""
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        return Csr(ptr, np.arange(ptr[-1]), np.ones(int(ptr[-1]), np.int64), int(ptr[-1]))

    @staticmethod
    def of_places(places: np.ndarray, width: int) -> Csr:
        """Row i has a one in column places[i]: tokens over groups."""
        return Csr(np.arange(len(places) + 1), places, np.ones(len(places), np.int64), width)

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(len(self)), np.diff(self.ptr))
        ptr = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(ptr, rows[order], self.values[order], len(self))

    def rows(self, start: int, end: int) -> Csr:
        a, b = self.ptr[start], self.ptr[end]
        return Csr(self.ptr[start : end + 1] - a, self.columns[a:b], self.values[a:b], self.width)

    def blocks(self, other: Csr) -> Iterator[tuple[int, Csr]]:
        """The product's rows in blocks, each with the number of its first row."""
        work = np.concatenate([[0], np.cumsum(np.diff(other.ptr)[self.columns])])[self.ptr]
        start = 0
        while start < len(self):
            end = max(start + 1, int(np.searchsorted(work, work[start] + BLOCK, "right")) - 1)
            yield start, self.rows(start, end)._product(other)
            start = end

    def product(self, other: Csr) -> Csr:
        parts = [p for _, p in self.blocks(other)]
        if not parts:
            return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), other.width)
        ptr = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.ptr) for p in parts]))])
        return Csr(ptr, np.concatenate([p.columns for p in parts]), np.concatenate([p.values for p in parts]), other.width)

    def _product(self, other: Csr) -> Csr:
        """Row i is the sum of the other's rows that row i names, each times its value."""
        counts = np.diff(other.ptr)[self.columns]
        at = segments.spread(other.ptr[:-1][self.columns], counts)
        rows = np.repeat(np.repeat(np.arange(len(self)), np.diff(self.ptr)), counts)
        keys, values = rows * other.width + other.columns[at], np.repeat(self.values, counts) * other.values[at]
        if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        found = keys[first]
        ptr = np.searchsorted(found, np.arange(len(self) + 1) * other.width)
        return Csr(ptr, found % other.width if other.width else found, np.add.reduceat(values, first) if len(first) else values, other.width)

    def times(self, vector: np.ndarray) -> np.ndarray:
        """The sum over each row of values times the vector's entries."""
        total = np.concatenate([[0], np.cumsum(self.values * vector[self.columns])])
        return total[self.ptr[1:]] - total[self.ptr[:-1]]


class Aligned:
    """Texts (without their first space) that both tokenise: ids, groups and links, one text's after another's.

    `valid` tells where the joined bytes of both are the text; others keep no tokens.
    """

    def __init__(self, a: segments.ByteLevel, b: segments.Pieces, of: segments.Segments):
        self.ids, self.bounds, sizes = [], [], []
        found, length = [segments.encode(v, of) for v in (a, b)], of.sizes
        text = np.frombuffer((" " + " ".join(of.texts)).encode() if of.texts else b"", np.uint8)
        starts = np.concatenate([[0], np.cumsum(length)])
        self.valid = np.ones(len(length), bool)
        for v, (ids, bounds) in zip((a, b), found):
            own, n = segments.joined_bytes(v, ids), np.concatenate([[0], np.cumsum(v.size[ids])])[bounds]
            if not np.array_equal(own, text) or not np.array_equal(n, starts):
                self.valid &= np.array([np.array_equal(own[n[i] : n[i + 1]], text[starts[i] : starts[i + 1]]) for i in range(len(length))], bool)
        for v, (ids, bounds) in zip((a, b), found):
            count = np.diff(bounds) * self.valid
            self.ids.append(ids[segments.spread(bounds[:-1], count)].astype(np.int64))
            self.bounds.append(np.concatenate([[0], np.cumsum(count)]))
            sizes.append(v.size[self.ids[-1]])
        ends = [np.cumsum(s) for s in sizes]
        common = ends[0][np.isin(ends[0], ends[1], assume_unique=True)]
        self.group_of = [np.searchsorted(common, e) for e in ends]
        self.group_bounds = np.concatenate([[0], np.searchsorted(common, np.cumsum(length * self.valid), "right")])
        self.overlaps = self._overlaps(*sizes, length * self.valid)

    def _overlaps(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> Csr:
        """Tokens of A over those of B: no token reaches across texts, so some texts at a time have their token-byte matrices built."""
        cuts = np.flatnonzero(np.diff(np.cumsum(length) // BLOCK)) + 1
        parts, first = [], [0, *cuts.tolist()]
        for i, j in zip(first, [*first[1:], len(length)]):
            (a0, a1), (b0, b1) = (n[[i, j]] for n in self.bounds)
            found = Csr.of_sizes(a[a0:a1]).product(Csr.of_sizes(b[b0:b1]).transposed())
            parts.append((np.diff(found.ptr), found.columns + b0, found.values))
        n, columns, values = (np.concatenate(x) for x in zip(*parts))
        return Csr(np.concatenate([[0], np.cumsum(n)]), columns, values, len(b))

    def shared(self) -> tuple[Csr, Csr]:
        """The group incidence of A's tokens and the transpose of B's: their product has all links within groups."""
        n = int(self.group_bounds[-1])
        a, b = (Csr.of_places(g, n) for g in self.group_of)
        return a, b.transposed()

    def link_bounds(self) -> np.ndarray:
        return self.overlaps.ptr[self.bounds[0]]

    def group_texts(self) -> pa.Array:
        """Each text's groups as `a1,a2|b1;a3|b2`."""
        n = int(self.group_bounds[-1])
        sides = []
        for ids, group in zip(self.ids, self.group_of):
            lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n))]), pc.cast(pa.array(ids), pa.large_string()))
            sides.append(pc.binary_join(lists, pa.scalar(",", pa.large_string())))
        groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
        return pc.binary_join(pa.LargeListArray.from_arrays(self.group_bounds, groups), pa.scalar(";", pa.large_string()))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both tokenisations of each whole text and how they meet, without counts over the corpus.

    (id, ids_a, ids_b, groups, links, n_shared): a group is {a, b}, the numbers
    of tokens of either; a link is {a, b, bytes}, token positions and the bytes
    they share; n_shared counts pairs of tokens in one group, from the vector
    product of the group incidences, not by listing them.  Rows as in `link_statistics`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = segments.byte_level(path_a), segments.pieces(path_b)
        for part in (c for x in batches for c in words.chunks(x, size=CHUNK_BYTES)):
            texts = pc.fill_null(part.column(1), "").cast(pa.large_string())
            has = pc.not_equal(texts, "")
            took = np.concatenate([[0], np.cumsum(has.to_numpy(zero_copy_only=False))])
            of = Aligned(a, b, segments.Segments(texts.filter(has), np.arange(took[-1]), np.arange(took[-1] + 1)))
            ids = [pa.ListArray.from_arrays(pa.array(n[took], pa.int32()), pa.array(i, pa.int32())) for i, n in zip(of.ids, of.bounds)]
            n = int(of.group_bounds[-1])
            groups = pa.StructArray.from_arrays([pa.array(np.bincount(g, minlength=n), pa.int32()) for g in of.group_of], ["a", "b"])
            links, row = of.overlaps, np.repeat(np.arange(len(of.overlaps)), np.diff(of.overlaps.ptr))
            text_of = np.searchsorted(of.bounds[0], row, "right") - 1
            link = pa.StructArray.from_arrays([pa.array(row - of.bounds[0][text_of], pa.int32()), pa.array(links.columns - of.bounds[1][text_of], pa.int32()), pa.array(links.values, pa.int32())], ["a", "b", "bytes"])
            x, y = of.shared()
            per_token = np.concatenate([[0], np.cumsum(x.times(y.times(np.ones(y.width, np.int64))))])
            yield pa.RecordBatch.from_arrays([
                part.column(0), *ids, pa.ListArray.from_arrays(pa.array(of.group_bounds[took], pa.int32()), groups), pa.ListArray.from_arrays(pa.array(of.link_bounds()[took], pa.int32()), link),
                pa.array(np.diff(per_token[of.bounds[0]][took])),
            ], [id_col, "ids_a", "ids_b", "groups", "links", "n_shared"])

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids_a array<int>, ids_b array<int>, groups array<struct<a: int, b: int>>, links array<struct<a: int, b: int, bytes: int>>, n_shared long")


def _chunk(part: pa.RecordBatch, a: segments.ByteLevel, b: segments.Pieces) -> pa.RecordBatch:
    """The documents of a part as one row: their figures, the matrix of documents over id pairs, and how many hold each pair."""
    cut = segments.split(part.column(1)) if b.safe else segments.listed(part.column(1).to_pylist(), lambda t: [t])
    of = Aligned(a, b, cut)
    broken = np.diff(np.concatenate([[0], np.cumsum(~of.valid[cut.codes])])[cut.bounds]) > 0
    if broken.any():  # the bytes of a segment are not its tokens': such texts are judged whole, each as one segment
        cut = segments.listed(list(zip(broken, part.column(1).to_pylist())), lambda x: [] if not x[1] else [x[1]] if x[0] else segments.SAFE.split(x[1]))
        of = Aligned(a, b, cut)
    codes, bounds = cut.codes, cut.bounds

    def total(per_segment: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(per_segment[codes])])[bounds])

    digests = [""] * part.num_rows
    kept = of.valid[codes]
    at = np.concatenate([[0], np.cumsum(kept)])[bounds]
    lists = pa.LargeListArray.from_arrays(at, of.group_texts().take(pa.array(codes[kept])))
    for i, joined in enumerate(pc.binary_join(lists, pa.scalar(";", pa.large_string())).cast(pa.large_binary())):
        if at[i + 1] > at[i]:
            digests[i] = hashlib.sha256(joined.as_buffer()).hexdigest()
    row = np.repeat(np.arange(len(of.overlaps)), np.diff(of.overlaps.ptr))
    keys = of.ids[0][row] << 32 | of.ids[1][of.overlaps.columns]
    pairs, pair_of = np.unique(keys, return_inverse=True)
    link_bounds = of.link_bounds()
    held = Csr(bounds, codes, np.ones(len(codes), np.int64), len(cut.texts))
    links = held.product(Csr(link_bounds, pair_of, np.ones(len(keys), np.int64), len(pairs)))
    figures = [total(np.diff(x)) for x in (of.bounds[0], of.bounds[1], of.group_bounds, link_bounds)]
    rows = {
        "chunk": pa.array([uuid.uuid4().hex]), "ids": _one(part.column(0)), **{n: _one(pa.array(v)) for n, v in zip(("n_a", "n_b", "n_groups", "n_links"), figures)},
        "digests": _one(pa.array(digests, pa.string())), "ends": _one(pa.array(links.ptr[1:], pa.int32())), "codes": _one(pa.array(links.columns, pa.int32())), "times": _one(pa.array(links.values, pa.int32())),
        "pairs": _one(pa.array(pairs)), "held_by": _one(pa.array(np.bincount(links.columns, minlength=len(pairs)), pa.int32())),
    }
    return pa.RecordBatch.from_arrays(list(rows.values()), list(rows))


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best) over the corpus: documents that hold the id pair linked, and whether no pair of its A id has more."""
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "held_by")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.held_by").cast("long")).alias("count"))
    counts = scratch.table(counts, "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_statistics(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    A (a byte-level `.json`) takes the text with a space before it, B (a piece
    `.model`) the text; special strings are ordinary text.  A pair's count is
    the number of rows that hold it linked; n_best counts links whose pair has
    the highest count of its A id, ties included; count_sum adds the counts of
    all links.  A text that is null, empty or not the joined bytes of its
    tokens has no tokens: zeros, and '' for the digest.  Repeated rows count
    as often as they occur and give a row each, null ids too; a very long text
    is alone in its chunk; an empty table gives no rows; other columns may
    have any name.

    Documents are taken in chunks of about CHUNK_BYTES.  A chunk lists each of
    its id pairs once, with the documents that hold it, and keeps its matrix of
    documents over pairs; only these lists are counted and joined, and the
    counts go back to the chunk that asked for them, in a list no longer than
    its own.  No pair list of the corpus is broadcast or collected.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = segments.byte_level(path_a), segments.pieces(path_b)
        for part in (c for x in batches for c in words.chunks(x, size=CHUNK_BYTES)):
            yield _chunk(part, a, b)
            pa.default_memory_pool().release_unused()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (x.slice(k, 1) for x in batches for k in range(x.num_rows)):
            col = {n: pc.list_flatten(r.column(i)) for i, n in enumerate(r.schema.names)}
            get = {n: col[n].to_numpy(zero_copy_only=False) for n in ("ends", "codes", "times", "found_at", "found_count", "found_best")}
            counts, best = np.zeros(len(get["found_at"]), np.int64), np.zeros(len(get["found_at"]), np.int64)
            counts[get["found_at"]], best[get["found_at"]] = get["found_count"], get["found_best"]
            links = Csr(np.concatenate([[0], get["ends"]]), get["codes"], get["times"].astype(np.int64), len(counts))
            yield pa.RecordBatch.from_arrays([col["ids"], *(col[n] for n in ("n_a", "n_b", "n_groups", "n_links")), pa.array(links.times(best)), pa.array(links.times(counts)), col["digests"]], names)

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    lists = "ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, ends array<int>, codes array<int>, times array<int>"
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    chunks = scratch.table(rows.mapInArrow(first, f"chunk string, {lists.format(kind=kind)}, pairs array<long>, held_by array<int>"), "aligned")
    asked = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    found = asked.join(pair_counts(chunks), "pair").groupBy("chunk").agg(F.collect_list(F.struct("at", "count", "best")).alias("found"))
    found = found.select(F.col("chunk").alias("of"), *(F.col(f"found.{c}").alias(f"found_{c}") for c in ("at", "count", "best")))
    empty = [F.coalesce(f"found_{c}", F.array().cast(f"array<{k}>")).alias(f"found_{c}") for c, k in (("at", "int"), ("count", "long"), ("best", "boolean"))]
    whole = chunks.drop("pairs", "held_by").join(found, F.col("chunk") == F.col("of"), "left").select(*(c for c in chunks.columns if c not in ("chunk", "pairs", "held_by")), *empty)
    return whole.mapInArrow(second, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
