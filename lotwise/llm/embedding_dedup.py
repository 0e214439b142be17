"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves with a codebook each; a cell is a pair of codes.
From a vector, cells are visited in the order of their distance by the
multi-sequence walk, as far as the target recall asks.  Vectors that meet in a
cell are compared by cosine.  Vectors of one direction are one class, and large
cells are compared in blocks, so that no group grows with the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import scratch
from lotwise.llm.components import components

#: Vectors that the codebooks are fitted on, in the mean; all vectors are indexed.
SAMPLE_ROWS = 20_000

#: Vectors of a label that a cell should hold, the fewest codes of a half, and sampled vectors that a code needs: these give the size of the codebooks.
CELL, FEWEST_CODES, PER_CODE = 2000, 4, 40

#: Vectors of a cell that are compared by one task at once, as visitors and as residents, and visitors at a time.
BLOCK, STEP = 4096, 512

#: Share of the pairs just at the threshold that one of the two must find; either may.
RECALL = 0.97

ROUNDS, SEED = 12, 11


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(ROUNDS):
        near = distances(x, centres).argmin(1)
        for c in range(k):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


class MultiIndex:
    def __init__(self, sample: np.ndarray, codes: int, cosine: float, recall: float = RECALL):
        rng = np.random.default_rng(SEED)
        self.half = sample.shape[1] // 2
        self.books = [kmeans(part, codes, rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        # A partner just at the threshold, in a random direction: how much farther than the nearest cell is its own?
        away = rng.normal(size=sample.shape)
        away -= (away * sample).sum(1, keepdims=True) * sample
        partner = cosine * sample + (1 - cosine**2) ** 0.5 * unit(away)
        there = self.home(partner)
        d = self.halves(sample)
        row = np.arange(len(sample))
        excess = sum(x[row, c] - x.min(1) for x, c in zip(d, there))
        self.reach = float(np.quantile(excess, recall)) + 1e-9

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return a.argmin(1), b.argmin(1)

    def cells(self, x: np.ndarray) -> Iterator[tuple[tuple[int, int], Iterator[tuple[int, int]]]]:
        """Home, and the cells to visit (home among them), of each vector."""
        a, b = self.halves(x)
        for k, home in enumerate(zip(a.argmin(1).tolist(), b.argmin(1).tolist())):
            yield home, self.walk(a[k], b[k])

    def walk(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells in the order of a[i] + b[j] while within reach of the nearest: the multi-sequence algorithm."""
        order = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        sa, sb = a[order[0]].tolist(), b[order[1]].tolist()
        limit = sa[0] + sb[0] + self.reach
        heap, seen = [(sa[0] + sb[0], 0, 0)], {(0, 0)}
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > limit:
                return
            yield order[0][i], order[1][j]
            for ni, nj in ((i + 1, j), (i, j + 1)):
                if ni < len(sa) and nj < len(sb) and (ni, nj) not in seen:
                    seen.add((ni, nj))
                    heapq.heappush(heap, (sa[ni] + sb[nj], ni, nj))

    def visits(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether x[r] visits cell (i[c], j[c]), for all r and c."""
        a, b = self.halves(x)
        return a[:, i] + b[:, j] <= (a.min(1) + b.min(1) + self.reach)[:, None]


class OneCell:
    """In place of an index where all sampled vectors of a dimension are too few for two codes, or a vector has no halves."""

    def cells(self, x: np.ndarray) -> Iterator[tuple[tuple[int, int], list[tuple[int, int]]]]:
        return (((0, 0), [(0, 0)]) for _ in x)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)

    def visits(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.ones((len(x), len(i)), bool)


def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, dim, u) of rows (id, label, v): unit vectors; scaled by the largest component first, so that no square over- or underflows."""
    for batch in (b for b in batches if b.num_rows):
        n = batch.column(2).value_lengths().to_numpy()
        starts, x = np.cumsum(n) - n, batch.column(2).flatten().to_numpy()
        x = x / np.repeat(np.maximum.reduceat(np.abs(x), starts), n)
        x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, starts)), n) + 0.0
        u = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(x)]]), pa.int32()), pa.array(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), u], ["id", "label", "dim", "u"])


def linked_groups(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the rows and of the columns of a matrix of links; those without links have -1."""
    columns = np.arange(linked.shape[1])
    some = np.flatnonzero(linked.any(1))
    for r in some:
        own = columns[linked[r]]
        if (own != (least := own.min())).any():
            columns[np.isin(columns, own)] = least
    rows = np.full(len(linked), -1)
    rows[some] = columns[linked[some].argmax(1)]
    columns[~linked.any(0)] = -1
    return rows, columns


def fitted(classes: DataFrame, cosine: float, sample_rows: int, recall: float) -> dict[int, MultiIndex | OneCell]:
    """An index for each number of dimensions; of all vectors together about `sample_rows` come to the driver."""
    sizes = classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("dim").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("typical"))
    typical = {r["dim"]: (r["n"], r["typical"]) for r in sizes.toLocalIterator()}
    share = min(1.0, sample_rows / max(1, sum(n for n, _ in typical.values())))
    sample = classes.where(F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) < int(share * (1 << 30))).select("dim", "hash", "u").toArrow()
    dims, hashes = sample.column("dim").to_numpy(), sample.column("hash").to_numpy()
    out: dict[int, MultiIndex | OneCell] = {}
    for dim, (_, in_label) in typical.items():
        at = np.flatnonzero(dims == dim)
        codes = min(max(FEWEST_CODES, round((in_label / CELL) ** 0.5)), len(at) // PER_CODE)
        if codes < 2 or dim < 2:
            out[dim] = OneCell()
            continue
        own = sample.column("u").take(pa.array(at[np.argsort(hashes[at], kind="stable")])).combine_chunks()
        own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
        out[dim] = MultiIndex(own.flatten().to_numpy().reshape(-1, dim), codes, cosine, recall)
    return out


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: vectors of one label with a cosine of at least `cosine`.

    Cosines are in double precision; no link below the threshold is made.  A
    vector that is null, empty, zero, or holds a null or non-finite component,
    or whose label is null, links with nothing; so do vectors of different
    dimensions.  Very large and very small components and vectors of one
    dimension are compared like any others.  Fewer than 2 * PER_CODE sampled vectors
    of a dimension share one cell.  n_links counts the other rows linked
    directly, equal ones too; component_id is the smallest id reachable, and kept
    marks it.  Ids are longs; rows that repeat an id are vectors of their own, and
    a row without an id links with nothing.  Only the three columns named are
    read; others may have any name.  Codebooks and the reach of a visit are fitted
    on about `sample_rows` vectors, for pairs just at the threshold.  An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", good)
    kind = rows.schema["label"].dataType.simpleString()
    fine = rows.where("ok").select("id", "label", "v").mapInArrow(directions, f"id long, label {kind}, dim int, u array<double>")
    fine = scratch.table(fine.withColumn("hash", F.xxhash64("u")), "directions")
    same = ["label", "dim", "hash", "u"]
    classes = scratch.table(fine.groupBy(*same).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = spark.sparkContext.broadcast(fitted(classes, cosine, sample_rows, recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = part.column(4).flatten().to_numpy().reshape(-1, dim)
                placed = [(r, *cell, first) for r, (home, cells) in enumerate(shared.value[int(dim)].cells(x)) for first, some in ((True, [home]), (False, cells)) for cell in some]
                row, i, j, resident = zip(*placed)
                took = [part.column(c).take(pa.array(row, pa.int64())) for c in range(5)]
                yield pa.RecordBatch.from_arrays([*took, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(resident)], ["label", "dim", "node", "size", "u", "i", "j", "resident"])

    placed = classes.select("label", "dim", "node", "size", "u").mapInArrow(place, f"label {kind}, dim int, node long, size long, u array<double>, i int, j int, resident boolean")
    placed = scratch.table(placed, "placed")
    cell = ["label", "dim", "i", "j"]
    blocks = placed.groupBy(*cell).agg(F.ceil(F.count_if("resident") / BLOCK).cast("int").alias("r"), F.ceil(F.count_if(~F.col("resident")) / BLOCK).cast("int").alias("q"))
    blocks = scratch.table(blocks.where("r > 0 and q > 0"), "blocks")
    mine, n_mine, n_other = F.col("resident"), F.when(F.col("resident"), F.col("r")).otherwise(F.col("q")), F.when(F.col("resident"), F.col("q")).otherwise(F.col("r"))
    dealt = placed.join(blocks, cell).withColumn("own", F.pmod(F.xxhash64("node"), n_mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_other - 1)))
    dealt = dealt.select(*cell, F.when(mine, F.col("own")).otherwise(F.col("other")).alias("r"), F.when(mine, F.col("other")).otherwise(F.col("own")).alias("q"), "resident", "node", "size", "u")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dim = group.column("dim")[0].as_py()
        index, here = shared.value[dim], group.column("resident").to_numpy()
        nodes, sizes = group.column("node").to_numpy(), group.column("size").to_numpy()
        x = pa.concat_arrays(group.column("u").chunks).flatten().to_numpy().reshape(-1, dim)
        y, b, size_b = x[here], nodes[here], sizes[here]
        x, a, size_a = x[~here], nodes[~here], sizes[~here]
        hi, hj = index.home(x)
        found = []
        for k in range(0, len(a), STEP) if len(b) else ():
            some = slice(k, k + STEP)
            linked = (x[some] @ y.T >= cosine) & (a[some, None] != b[None, :])
            if not linked.any():
                continue
            links = linked @ size_b
            # A resident that visits the visitor's cell counts the link there, else here.
            here_only = np.zeros_like(linked)
            row, to = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            here_only[np.ix_(row, to)] = linked[np.ix_(row, to)] & ~index.visits(y[to], hi[some][row], hj[some][row]).T
            more = size_a[some] @ here_only
            rows_in, columns_in = linked_groups(linked)
            ids, groups = np.concatenate([a[some], b]), np.concatenate([rows_in, columns_in])
            counts, ids, groups = np.concatenate([links, more])[groups >= 0], ids[groups >= 0], groups[groups >= 0]
            root = np.full(len(b), np.iinfo(np.int64).max)
            np.minimum.at(root, groups, ids)
            found.append((ids, counts, root[groups]))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(columns, ["node", "links", "root"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(n, *cell, "r", "q").groupBy(*cell, "r", "q").applyInArrow(compare, "node long, links long, root long")
    found = scratch.table(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select("node", "root")).withColumnRenamed("node", "member")
    classed = classes.select(*same, "node", "least", "size").join(counts, "node", "left").join(parts, F.col("node") == F.col("member"), "left")
    classed = scratch.table(classed.select(*same, "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("part")), "classed")
    least = classed.groupBy("part").agg(F.min("least").alias("component_id"))
    linked = fine.join(classed.join(least, "part").drop("part", "least"), same).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
