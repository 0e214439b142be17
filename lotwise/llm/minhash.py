"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

Documents with equal shingle sets form a class and go on as one.  Classes that
share a band form a bucket.  A bucket's members are first compared with its
centre, the member that meets most others; the links found make components.
Members of buckets with several components go on: two linked sets share one of
their rarest elements (the prefix filter), at places that leave room for the
overlap (the positional filter).  Members that share such an element are again
first compared with a centre, and at last all pairs whose components still
differ.  So a bucket of thousands of copies of one text costs thousands of
comparisons, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm import scratch, words
from lotwise.llm.components import components

#: Chance that a pair exactly at the threshold shares no band.
MISSED = 5e-7

#: Elements whose permutations are held at once.
ELEMENTS = 200_000

#: Rounds of centres among members that share a rare element, before the pairs that are left.
STAR_ROUNDS = 2

#: Bits of the filter through which texts pass whose sets are compared, at most (8 MB); a fuller filter lets more pass.
MOST_BITS = 1 << 26

#: Bits of the table of element frequencies that orders elements; any order gives all links, a better one fewer pairs.
ORDER_BITS = 20


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of each for a similarity of `percent` hundredths."""
    rows = 5 if percent >= 85 else 4
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** rows)), rows


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, one text after another, and their bounds.

    A text of fewer words than `size` has its whole sequence as one shingle, one without words has none.
    """
    distinct, codes, bounds = words.split(pc.ascii_lower(pc.fill_null(texts, "")))
    h = words.hashes(distinct)[codes]

    def fold(at: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(at), n, np.uint64)
        for j in range(n):
            out = words.mix(out + h[at + j])
        return out

    whole = fold(np.arange(max(0, len(h) - size + 1)), size)
    sets, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for d, (start, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        n = end - start
        if not n:
            continue
        if n < size:
            found = fold(np.array([start]), n)
        else:
            found = np.sort(whole[start : end - size + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        sets.append(found)
        sizes[d] = len(found)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def level_bits(slots: int) -> int:
    """Bits of a signature's 32 that hold the fraction; those above hold levels 0 to slots - 1."""
    return 32 - max(1, (slots - 1).bit_length())


def superminhash(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (sets x slots) of SuperMinHash, the value of level j and fraction r held as the integer (j, r).

    Each element deals itself out over the slots by a permutation of its own:
    at level j it offers j + r to its j-th slot.  A set is finished as soon as
    no slot is above the level, so that most stop after a few levels.
    """
    n_sets, m, low = len(bounds) - 1, slots, level_bits(slots)
    sig = np.full(n_sets * m, 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))

    def draw(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        r = words.mix(x + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = np.uint64(level << low) | (r >> np.uint64(64 - low))
        return value.astype(np.uint32), (level + (((r & np.uint64(0x7FFFFFFF)) * np.uint64(m - level)) >> np.uint64(31))).astype(np.int64)

    value, slot = draw(elements, 0)
    np.minimum.at(sig, owner * m + slot, value)
    sig = sig.reshape(n_sets, m)
    rest = np.flatnonzero((sig.max(1) >= (1 << low)) & (np.diff(bounds) > 0))
    sizes = np.diff(bounds)[rest]
    parts = np.searchsorted(np.cumsum(sizes), np.arange(ELEMENTS, sizes.sum() + ELEMENTS, ELEMENTS), "left") + 1 if len(rest) else []
    for start, end in zip([0, *parts], parts):
        sets = rest[start:end]
        if not len(sets):
            continue
        at = np.concatenate([np.arange(bounds[s], bounds[s + 1]) for s in sets])
        x, own = elements[at], owner[at]
        order = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
        first = slot[at]
        order[np.arange(len(x)), first] = 0
        order[:, 0] = first
        for level in range(1, m):
            open_ = (sig[sets].max(1) >= (level << low))
            if not open_.any():
                break
            if not open_.all():
                keep = np.isin(own, sets[open_])
                sets, x, own, order = sets[open_], x[keep], own[keep], order[keep]
            value, k = draw(x, level)
            row = np.arange(len(x))
            to = order[row, k]
            order[row, k] = order[:, level]
            order[:, level] = to
            flat = sig.reshape(-1)
            np.minimum.at(flat, own * m + to, value)
    return sig


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (c for b in batches for c in words.chunks(b)):
            elements, bounds = shingle_sets(part.column(1), size)
            n, some = np.diff(bounds), np.diff(bounds) > 0
            starts = bounds[:-1][some]
            sums = []
            for salt in (0, 0x5851F42D4C957F2D):
                out = np.zeros(len(n), np.uint64)
                if len(starts):
                    out[some] = np.add.reduceat(words.mix(elements ^ np.uint64(salt)), starts)
                sums.append(pa.array(out.view(np.int64)))
            sig = superminhash(elements, bounds, bands * rows).reshape(len(n), bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(n), bands)).copy()
            for r in range(rows):
                key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            key = key[some].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]), pa.int32()), pa.array(key.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), *sums, lists], ["id", "own", "n", "k1", "k2", "bands"])

    return run


def _sets(size: int, shared):
    """Shingle sets of the texts in a Bloom filter, where the texts are read: all that are wanted, and a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (b.filter(pa.array(in_bloom(shared.value, b.column(2).to_numpy()))) for b in batches)
        for part in (c for b in wanted for c in words.chunks(b)):
            elements, bounds = shingle_sets(part.column(1), size)
            raw = pa.py_buffer(elements.tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int64).tobytes()), raw]).cast(pa.binary())], ["id", "own", "shingles"])

    return run


def _bits(ids: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places for each id in a Bloom filter of `size` bits."""
    x = words.mix(ids.astype(np.int64).view(np.uint64))
    return [x % np.uint64(size), words.mix(x) % np.uint64(size)]


def bloom(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the only column's longs: 16 bits for each of n, but at most MOST_BITS, which bounds what comes to the driver."""
    size = min(MOST_BITS, 1 << max(10, (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    found = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def in_bloom(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    a, b = _bits(ids, len(filter_) << 6)
    there = lambda x: (filter_[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)
    return (there(a) & there(b)).astype(bool)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            counts += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "c"])


def _rarest(percent: int, shared):
    """Of each set, the elements of which a linked set must share one, with their places in the order of frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            found, places = [], []
            for x in batch.column(2):
                e = np.frombuffer(x.as_buffer(), np.uint64)
                by = np.lexsort((e, order[(e >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]))
                found.append(e[by[: len(e) + percent * len(e) // -100 + 1]])
                places.append(np.arange(len(found[-1])))
            n = np.array([len(f) for f in found], np.int64)
            row = pa.array(np.repeat(np.arange(len(n)), n))
            columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "n", "element", "place"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int(np.count_nonzero(b[at] == a))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            kept = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return run


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart that share an id."""
    return F.xxhash64(doc_id.cast("long"), text)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, with_key: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept[, row_key]): groups of documents with near-equal sets of `size`-word shingles.

    Words lie between ASCII white space, A-Z in lower case.  Two documents are
    linked if 100 * |both sets| >= percent * |either set|, on the full sets;
    component_id is the smallest id reachable by links, and kept marks it.
    A text of fewer words has its whole sequence as one shingle; a null text or
    one without words has none, and is linked with nothing.  Very long texts are
    sets like any others.  Ids must be longs; rows that repeat an id are
    documents of their own, whatever their texts, and of one that is kept all
    rows with its id in that component are marked.  Rows with a null id are
    components of their own with a null component_id and kept.  Only the id and
    the text are read; other columns may have any name.  An empty table gives no
    rows.  row_key is that of `row_key`, which tells rows of one id apart.
    """
    bands, rows = banding(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("own"))
    sketch = scratch.table(texts.mapInArrow(_sketch(size, bands, rows), "id long, own long, n long, k1 long, k2 long, bands array<long>"), "sketch")
    same = ["k1", "k2", "n"]
    whose = F.struct("id", "own")  # the row of a class whose text is read again
    classes = sketch.where("n > 0 and id is not null").groupBy(*same).agg(F.min(whose).alias("of"), F.first("bands").alias("bands"))
    classes = scratch.table(classes.select("*", F.monotonically_increasing_id().alias("rep")), "classes")

    rows_ = classes.select("rep", "n", F.explode_outer("bands").alias("band"))
    shared = scratch.table(rows_.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    met = rows_.join(shared, "band").groupBy("rep", "n").agg(F.collect_list("band").alias("bands"), F.sum("c").alias("degree"))
    members = scratch.table(met.select("rep", "n", "degree", F.explode("bands").alias("band")), "members")

    wanted = scratch.table(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "of.id", "of.own"), "wanted")
    shared = texts.sparkSession.sparkContext.broadcast(bloom(wanted.select("own"), wanted.count()))
    near = texts.where("id is not null").mapInArrow(_sets(size, shared), "id long, own long, shingles binary")
    sets = scratch.table(near.join(wanted, ["id", "own"]).groupBy("rep").agg(F.first("shingles").alias("shingles")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
        b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")

    close = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    room = F.expr(f"{100 + percent} * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    side = lambda df, s, *cols: df.select(*cols, F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in ("rep", *cols)])

    rank = F.struct("degree", -F.col("rep"))
    centres = scratch.table(members.groupBy("band").agg(F.max(F.struct(rank.alias("rank"), "rep", "n")).alias("x")).select("band", "x.rep", "x.n"), "centres")
    star = side(members.drop("degree"), "b", "band").join(side(centres, "a", "band"), "band").where("a <> b").where(close).select(*pair).distinct()
    links = scratch.table(confirmed(star), "links")
    parts = scratch.table(components(links), "parts")

    def parted(df: DataFrame) -> DataFrame:
        return df.join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep")).drop("node", "component")

    now = scratch.table(parted(members.select("rep", "n", "band")), "parted")
    mixed = scratch.table(now.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band"), "mixed")
    open_ = scratch.table(now.join(mixed, "band").select("rep", "n").distinct().join(sets, "rep").select("rep", "n", "shingles"), "open")
    order = np.zeros(1 << ORDER_BITS, np.int64)
    counts = open_.select("shingles").mapInArrow(_frequencies, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    order[counts.column("bucket").to_numpy()] = counts.column("c").to_numpy()
    rare = open_.mapInArrow(_rarest(percent, texts.sparkSession.sparkContext.broadcast(order)), "rep long, n long, element long, place int")
    rare = scratch.table(rare, "rare")
    for round_ in range(1, STAR_ROUNDS + 1):
        here = scratch.table(parted(rare), f"rare-{round_}")
        chosen = F.struct(F.xxhash64("rep", F.lit(round_)).alias("x"), "rep", "n", "place", "part")
        centres = here.groupBy("element").agg(F.max(chosen).alias("x"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
        centres = scratch.table(centres.select("element", "x.rep", "x.n", "x.place", "x.part"), "centres")
        star = side(here, "b", "element").join(side(centres, "a", "element"), "element").where("part_a <> part_b").where(room).select(*pair).distinct()
        links = links.unionByName(scratch.table(confirmed(star), "links"))
        parts = scratch.table(components(links), "parts")
    here = scratch.table(parted(rare), "rare-last")
    # Of two sets, the smaller one needs a common element among fewer of its rarest: so pages that share just
    # a template, below the threshold, do not meet at its elements.
    few = here.where(f"{100 + percent} * (n - place) >= {2 * percent} * n")
    smaller = F.struct("n_a", "a") < F.struct("n_b", "b")
    rest = side(few, "a", "element").join(side(here, "b", "element"), "element").where("part_a <> part_b").where(smaller).where(room).select("a", "b").distinct()
    links = links.unionByName(scratch.table(confirmed(rest), "rest"))
    parts = scratch.table(components(links), "parts")

    placed = classes.select(*same, "rep", F.col("of.id").alias("least")).join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep"))
    placed = scratch.table(placed.select(*same, "part", "least"), "placed")
    final = scratch.table(placed.join(placed.groupBy("part").agg(F.min("least").alias("component_id")), "part").drop("part", "least"), "final")
    one = sketch.where("n > 0 and id is not null").select("id", "own", *same).join(final, same).select("id", "n", "component_id", "own")
    alone = sketch.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"), "own")
    return one.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *([F.col("own").alias("row_key")] if with_key else []))
