"""Repeated passages of at least `span` bytes, removed wherever they occur.

A full suffix array of the corpus writes several times the text to disk (see
README), so suffixes are sampled first.  Among the grams of half a span in each
window of `span` bytes the one of the smallest hash is the window's anchor:
equal windows have equal anchors at the same offset.  Consecutive windows of one
anchor are a run, as many bytes long as they reach.  Anchors that occur once are
done.  A run that occurs twice as a whole is repeated as a whole; where an
anchor has several kinds of runs, those that occur once, and one of each other
kind, go on in blocks of BLOCK windows, placed relative to the anchor.  A block
is known by the bytes that all its windows share, and settled in the same way;
what is still open is counted window by window.  Everything is counted with
pre-aggregation, so a passage in every document is no larger a group than others.

`shared_passages` finds documents that share a passage counted in words in the
same way, with word hashes in place of bytes; `without_passages` cuts what
either count finds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import scratch, words
from lotwise.llm.minhash import bloom, in_bloom

SPAN = 400

#: Words of a shared passage, and of the grams among which its anchors are chosen.
WORD_SPAN, WORD_GRAM = 50, 13

#: Bytes hashed at once.  Positions must fit the low bits that break ties.
PIECE, LOW_BITS = 1 << 19, np.uint64(20)

#: Windows that are settled at once before they are counted one by one.
BLOCK = 16

BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of substrings of a byte array, from prefix sums over a polynomial modulo 2^64."""

    power = inverse = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        if len(Hasher.power) <= len(raw):
            size = max(2 * PIECE, len(raw) + 1)
            Hasher.power, Hasher.inverse = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(words.mix(raw.astype(np.uint64) + np.uint64(1)) * self.inverse[: len(raw)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return words.mix((self.sums[end] - self.sums[start]) * self.power[start])

    def every(self, size: int) -> np.ndarray:
        """Of the substrings of `size` bytes at each position."""
        n = len(self.sums) - size
        return words.mix((self.sums[size:] - self.sums[:n]) * self.power[:n]) if n > 0 else np.zeros(0, np.uint64)


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` consecutive elements."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int, gram: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, context, first window, further windows, place of the anchor after the first) of each run in an array of several texts.

    Elements are bytes or word hashes; grams have half a span of them where no number is given.
    """
    gram = gram or span // 2
    if len(raw) < span:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    h = Hasher(raw)
    grams = h.every(gram)
    low = np.uint64((1 << int(LOW_BITS)) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(keys, span - gram + 1) & low).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int32)
    long_ = ends - starts >= span
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - span + 1, -1)
    valid = np.cumsum(inside)[: len(anchor)] > 0
    begin = np.zeros(len(anchor), bool)
    begin[starts[long_]] = True  # windows of neighbouring texts are never in one run
    begin[1:] |= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(begin & valid)
    if not len(lo):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), lo, lo, lo
    stop = np.concatenate([begin | ~valid, [True]])
    breaks = np.flatnonzero(stop)
    hi = breaks[np.searchsorted(breaks, lo, "right")] - 1
    p = anchor[lo]
    context = words.mix(h.between(lo, hi + span) + ((p - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64))
    return grams[p], context, lo, hi - lo, p - lo


def blocks(h: Hasher, lo: np.ndarray, more: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(common bytes, context, first window, further windows) of the blocks of runs."""
    first, last = -off // BLOCK, (more - off) // BLOCK
    n = last - first + 1
    run = np.repeat(np.arange(len(lo)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[run]
    start = lo[run] + off[run] + BLOCK * k
    a, b = np.maximum(start, lo[run]), np.minimum(start + BLOCK - 1, lo[run] + more[run])
    common = words.mix(h.between(start + BLOCK - 1, start + span))
    return common, words.mix(h.between(a, b + span) + ((a - start).astype(np.uint64) << np.uint64(32)) + (b - a).astype(np.uint64)), a, b - a


def settle(items: DataFrame, name: str) -> DataFrame:
    """(id, h, at, more, off, whole, asks) of the items (id, h, key, context, at, more, off) whose key occurs again.

    whole: the context occurs again too.  asks: it does not, or it stands for
    its equals where the key has other contexts besides.
    """
    twice = items.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    some = scratch.table(items.join(scratch.table(twice, f"{name}-twice"), "key"), f"{name}-some")
    place = F.xxhash64("id", "h", "at")
    several = some.groupBy("key").agg((F.min("context") != F.max("context")).alias("several"))
    kinds = some.groupBy("key", "context").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("chosen"))
    known = scratch.table(kinds.join(scratch.table(several, f"{name}-several"), "key"), f"{name}-known")
    whole = F.col("c") > 1
    asks = ~whole | (F.col("several") & (place == F.col("chosen")))
    return some.join(known, ["key", "context"]).select("id", "h", "at", "more", "off", whole.alias("whole"), asks.alias("asks"))


def _pieces(texts: Iterable[np.ndarray], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]]:
    """Texts, as arrays of bytes or words, in arrays of about PIECE elements: elements, starts, ends, row and offset of each part."""
    parts: list[np.ndarray] = []
    rows: list[int] = []
    offsets: list[int] = []
    held = 0

    def take():
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        return np.concatenate(parts), ends - [len(p) for p in parts], ends, rows, offsets

    for row, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - span + 1), PIECE):
            part = raw[at : at + PIECE + span - 1]
            if len(part) < span:
                continue
            if held + len(part) > PIECE + span and parts:
                yield take()
                parts, rows, offsets, held = [], [], [], 0
            parts.append(part)
            rows.append(row)
            offsets.append(at)
            held += len(part)
    if parts:
        yield take()


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8) for t in column)


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    distinct, codes, bounds = words.split(pc.ascii_lower(column))
    found = words.hashes(distinct)[codes]
    return (found[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, h, doc): doc stands for the id and the text."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("doc", F.xxhash64("id", "h"))


def _word_runs(texts: DataFrame, span: int, gram: int, columns: list[str]) -> DataFrame:
    """The columns of (doc, key, context, at, more) of the runs in words; at and more count words."""
    kinds = {"doc": "long", "key": "long", "context": "long", "at": "long", "more": "int"}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (c for b in batches for c in words.chunks(b)):
            for raw, starts, ends, rows, offsets in _pieces(_words(part.column(1)), span):
                key, context, lo, more, _ = runs(raw, starts, ends, span, gram)
                piece = np.searchsorted(starts, lo, "right") - 1
                found = {
                    "doc": part.column(0).take(pa.array(np.asarray(rows, np.int64)[piece])), "key": pa.array(key.view(np.int64)), "context": pa.array(context.view(np.int64)),
                    "at": pa.array(lo - starts[piece] + np.asarray(offsets, np.int64)[piece]), "more": pa.array(more, pa.int32()),
                }
                yield pa.RecordBatch.from_arrays([found[c] for c in columns], columns)

    return texts.select("doc", "text").mapInArrow(sample, ", ".join(f"{c} {kinds[c]}" for c in columns))


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = WORD_SPAN, gram: int = WORD_GRAM) -> DataFrame:
    """(id, text_hash), once each, of the documents with `span` words in a row that another document has too.

    Words lie between ASCII white space, A-Z in lower case, and are compared as
    64-bit hashes.  Rows with the same id and text are one document, rows that
    repeat an id with other texts are several; null ids are allowed; a null text
    has no words.  Only the id and the text are read.  text_hash is xxhash64 of
    the text, a null one being empty.
    """
    texts = _known(docs, id_col, text_col)
    sampled = scratch.table(_word_runs(texts, span, gram, ["doc", "key", "context"]), "word-runs")
    several = [F.min("doc").alias("lo"), F.max("doc").alias("hi")]
    keys = scratch.table(sampled.groupBy("key").agg(*several).where("lo < hi").select("key"), "word-keys")
    some = scratch.table(passing(sampled, "key", keys).join(keys, "key"), "word-some")  # a stage of its own, so that a hot key can be split
    kinds = scratch.table(some.groupBy("key", "context", "doc").agg(F.count(F.lit(1)).alias("c")), "word-kinds")
    whole = scratch.table(kinds.groupBy("key", "context").agg(*several), "word-contexts")
    done = scratch.table(kinds.join(whole.where("lo < hi"), ["key", "context"], "left_semi").select("doc").distinct(), "word-done")
    # Documents without a whole run in common: their windows, and those of one document for each other context of a key.
    open_keys = kinds.join(done, "doc", "left_anti").select("key").distinct()
    ask = whole.join(open_keys, "key", "left_semi").groupBy(F.col("lo").alias("doc")).agg(F.collect_set("key").alias("keys"))
    ask = scratch.table(ask, "word-asked")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (c for b in batches for c in words.chunks(b)):
            asked = [np.sort(k.values.to_numpy()) for k in part.column(2)]
            for raw, starts, ends, rows, _ in _pieces(_words(part.column(1)), span):
                key, _, lo, more, _ = runs(raw, starts, ends, span, gram)
                row = np.asarray(rows, np.int64)[np.searchsorted(starts, lo, "right") - 1]
                wanted = np.zeros(len(lo), bool)
                for r in np.unique(row):
                    wanted[row == r] = np.isin(key[row == r].view(np.int64), asked[r])
                n = more[wanted] + 1
                at = np.repeat(lo[wanted] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(row[wanted], n))), pa.array(Hasher(raw).between(at, at + span).view(np.int64))], ["doc", "window"])

    near = passing(texts.select("doc", "text"), "doc", ask.select("doc")).dropDuplicates(["doc"]).join(ask, "doc").select("doc", "text", "keys")
    found = scratch.table(near.mapInArrow(windows, "doc long, window long").distinct(), "word-windows")
    met = found.join(found.groupBy("window").agg(*several).where("lo < hi"), "window", "left_semi").select("doc").distinct()
    shared = scratch.table(done.unionByName(met).distinct(), "word-shared")
    return texts.select("id", F.col("h").alias("text_hash"), "doc").join(shared, "doc", "left_semi").select(F.col("id").alias(id_col), "text_hash").distinct()


def _shared_runs(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc, at, more): runs of windows of `span` words that another document has too, all of them; at and more count words."""
    sampled = scratch.table(_word_runs(texts, span, gram, ["doc", "key", "context", "at", "more"]), "shared-runs")
    several = [F.min("doc").alias("lo"), F.max("doc").alias("hi")]
    keys = scratch.table(sampled.groupBy("key").agg(*several).where("lo < hi").select("key"), "shared-keys")
    some = scratch.table(passing(sampled, "key", keys).join(keys, "key"), "shared-some")
    kinds = scratch.table(some.groupBy("key", "context").agg(*several), "shared-kinds")
    opens = scratch.table(kinds.where("lo = hi").select("key").distinct().withColumn("opens", F.lit(True)), "shared-opens")
    known = scratch.table(kinds.join(opens, "key", "left"), "shared-known")
    # A window of a run that one document has is sought in that key's other runs, of which two documents that have one stand for all.
    whole = F.col("lo") < F.col("hi")
    asks = ~whole | (F.col("opens") & F.col("doc").isin(F.col("lo"), F.col("hi")))
    found = scratch.table(some.join(known, ["key", "context"]).select("doc", "at", "more", whole.alias("whole"), F.coalesce(asks, F.lit(False)).alias("asks")), "shared-found")
    ask = scratch.table(found.where("asks").groupBy("doc").agg(F.collect_set(F.struct("at", "more")).alias("open")), "shared-asked")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (c for b in batches for c in words.chunks(b)):
            for row, raw in enumerate(_words(part.column(1))):
                own = part.column(2)[row].values.flatten()
                at, more = (x.to_numpy().astype(np.int64) for x in own)
                for piece in np.unique(at // PIECE):
                    near, base = at // PIECE == piece, int(piece) * PIECE
                    s = np.unique(np.concatenate([np.arange(a, a + m + 1) for a, m in zip(at[near], more[near])]))
                    hashed = Hasher(raw[base : int(s[-1]) + span]).between(s - base, s - base + span)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.full(len(s), row))), pa.array(s), pa.array(hashed.view(np.int64))], ["doc", "at", "window"])

    near = passing(texts.select("doc", "text"), "doc", ask.select("doc")).dropDuplicates(["doc"]).join(ask, "doc").select("doc", "text", "open")
    windows = scratch.table(near.mapInArrow(single, "doc long, at long, window long"), "shared-windows")
    met = scratch.table(windows.groupBy("window").agg(*several).where("lo < hi").select("window"), "shared-met")
    hits = passing(windows, "window", met).join(met, "window").select("doc", "at", F.lit(0).alias("more"))
    return found.where("whole").select("doc", "at", "more").unionByName(hits)


def _word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in bytes."""
    inside = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    return edges[:, 0], edges[:, 1]


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, word_span: int = WORD_SPAN, gram: int = WORD_GRAM) -> DataFrame:
    """(id, text_hash, kept), once each, of the texts that lose something: kept are the bytes that remain.

    What repeated_passages removes goes, and so does every word of a passage of
    `word_span` words that another document has too (see shared_passages), with
    the white space between such words, however few bytes these are; if no word is left,
    nothing is.  Both are judged on the input.  Null ids, repeated rows and text_hash
    are as there; an empty table gives no rows.
    """
    texts = _known(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    in_bytes = repeated_passages(docs, id_col, text_col, span, with_kept=False).where("n_removed > 0").select(F.xxhash64(id_col, "text_hash").alias("doc"), "spans").dropDuplicates(["doc"])
    in_words = _shared_runs(texts, word_span, gram).groupBy("doc").agg(F.collect_set(F.struct("at", "more")).alias("runs"))
    gone = scratch.table(in_bytes.join(in_words, "doc", "full"), "gone-of-both")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (c for b in batches for c in words.chunks(b)):
            kept = []
            for row in range(part.num_rows):
                raw = np.frombuffer(part.column(1)[row].as_buffer(), np.uint8)
                change = np.zeros(len(raw) + 1, np.int32)
                for x in part.column(4)[row].as_py() or []:
                    change[x["start"]] += 1
                    change[x["end"]] -= 1
                if own := part.column(5)[row].as_py():
                    first, end = _word_places(raw)
                    at = np.array([(r["at"], r["at"] + r["more"] + word_span) for r in own])
                    hit = np.zeros(len(first) + 1, np.int32)
                    np.add.at(hit, at[:, 0], 1)
                    np.add.at(hit, at[:, 1], -1)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(hit)[:-1] > 0, [False]]).astype(np.int8))).reshape(-1, 2)
                    change[first[edge[:, 0]]] += 1
                    change[end[edge[:, 1] - 1]] -= 1
                left = raw[np.cumsum(change)[:-1] == 0].tobytes()
                kept.append(b"" if own and left.isspace() else left)
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(kept, pa.binary())], ["id", "h", "kept"])

    near = passing(texts.select("doc", "text", "id", "h"), "doc", gone.select("doc")).dropDuplicates(["doc"]).join(gone, "doc").select("doc", "text", "id", "h", "spans", "runs")
    return near.mapInArrow(cut, f"id {kind}, h long, kept binary").withColumnsRenamed({"id": id_col, "h": "text_hash"})


def passing(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose long `column` is in a Bloom filter of `wanted`'s only column: all of these, and a few more, before anything is shuffled."""
    shared, at = df.sparkSession.sparkContext.broadcast(bloom(wanted, wanted.count())), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(shared.value, batch.column(at).to_numpy())))

    return df.mapInArrow(run, df.schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_kept: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, text_hash, spans[, kept]) of every row.

    Texts are UTF-8 bytes.  Each byte that lies in a `span`-byte string which
    also starts anywhere else, in the same text or another, is removed; overlaps
    count.  spans are the removed runs, kept the bytes that remain, text_hash is
    xxhash64 of the text (to tell rows of one id apart).  A null text
    has no bytes; one shorter than `span` loses none; two rows with the same id
    are two texts.  Null ids are allowed.  Very long texts are read in pieces
    that overlap by a span.  Only the id and the text are read; other columns may
    have any name.  An empty table gives no rows.  Strings are compared by 64-bit
    hashes, so the result is exact but for collisions of these.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = texts.schema["id"].dataType.simpleString()

    long_enough = texts.where(F.octet_length("text") >= span).select("id", "h", "text")
    item = f"id {kind}, h long, key long, context long, at long, more int, off int"

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, starts, ends, rows, offsets in _pieces(_bytes(batch.column(2)), span):
                gram, context, lo, more, off = runs(raw, starts, ends, span)
                part = np.searchsorted(starts, lo, "right") - 1
                row = pa.array(np.asarray(rows, np.int64)[part])
                at = lo - starts[part] + np.asarray(offsets, np.int64)[part]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(at), pa.array(more, pa.int32()), pa.array(off, pa.int32())], [x.split(" ")[0] for x in item.split(", ")])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, Hasher, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text, piece by piece: row, place of the piece, its hashes, and what is open in it."""
        for batch in batches:
            for row in range(batch.num_rows):
                raw, own = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint8), batch.column(3)[row].as_py()
                at, more, off = (np.array([r[c] for r in own], np.int64) for c in ("at", "more", "off"))
                for piece in np.unique(at // PIECE):
                    near = at // PIECE == piece
                    base = int(piece) * PIECE
                    end = int((at + more)[near].max()) + span + BLOCK
                    yield batch, row, base, Hasher(raw[base:end]), at[near] - base, more[near], off[near]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, base, h, at, more, off in opened(batches):
            common, context, first, further = blocks(h, at, more, off, span)
            same = pa.array([row] * len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(common.view(np.int64)), pa.array(context.view(np.int64)), pa.array(first + base), pa.array(further, pa.int32()), pa.array(np.zeros(len(first)), pa.int32())], [x.split(" ")[0] for x in item.split(", ")])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, base, h, at, more, _ in opened(batches):
            s = np.unique(np.concatenate([np.arange(a, a + m + 1) for a, m in zip(at, more)]))
            same = pa.array([row] * len(s), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(h.between(s, s + span).view(np.int64)), pa.array(s + base)], ["id", "h", "key", "at"])

    def with_open(of: DataFrame, found: DataFrame, all_: bool) -> DataFrame:
        """Texts with what is open in them, and where asked for those with anything found."""
        part = F.struct("at", "more", "off")
        lists = found.groupBy(F.col("id").alias("of"), F.col("h").alias("of_h")).agg(F.collect_list(F.when(F.col("asks"), part)).alias("open"))
        lists = lists if all_ else lists.where(F.size("open") > 0)
        return of.join(lists, (F.col("h") == F.col("of_h")) & F.col("id").eqNullSafe(F.col("of"))).select("id", "h", "text", "open")

    sampled = scratch.table(long_enough.mapInArrow(sample, item), "runs")
    found_runs = scratch.table(settle(sampled, "runs"), "found-runs")
    work = scratch.table(with_open(long_enough, found_runs, True), "work")
    cut_ = scratch.table(work.where(F.size("open") > 0).mapInArrow(cut, item), "blocks")
    found_blocks = scratch.table(settle(cut_, "blocks"), "found-blocks")
    windows = with_open(work.drop("open"), found_blocks, False).mapInArrow(single, f"id {kind}, h long, key long, at long")
    windows = scratch.table(windows, "windows")
    twice = scratch.table(windows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "windows-twice")
    hits = windows.join(twice, "key").select("id", "h", "at", F.lit(0).alias("more"))
    gone = found_runs.where("whole").select("id", "h", "at", "more").unionByName(found_blocks.where("whole").select("id", "h", "at", "more")).unionByName(hits)
    gone = scratch.table(gone.groupBy(F.col("id").alias("of"), F.col("h").alias("of_h")).agg(F.collect_set(F.struct("at", "more")).alias("gone")), "gone")
    same = (F.col("h") == F.col("of_h")) & F.col("id").eqNullSafe(F.col("of"))

    names = ["id", "h", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if with_kept else [])]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, 2):
                out = []
                for row in range(part.num_rows):
                    raw = np.frombuffer(part.column(2)[row].as_buffer(), np.uint8)
                    ends = [(r["at"], r["at"] + r["more"] + span) for r in part.column(3)[row].as_py()]
                    change, a = np.zeros(len(raw) + 1, np.int32), np.array(ends)
                    np.add.at(change, a[:, 0], 1)
                    np.add.at(change, a[:, 1], -1)
                    hit = np.cumsum(change)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    kept = raw[~hit].tobytes()
                    out.append((len(raw), int(hit.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()], kept)[: 6 if with_kept else 5])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, k) for x, k in zip(zip(*out), kinds)]], names)

    joined = work.select("id", "h", "text").join(gone, same).select("id", "h", "text", "gone")
    schema = f"id {kind}, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * with_kept
    changed = joined.mapInArrow(remove, schema)
    rest = texts.join(gone, same, "left_anti") if with_kept else texts.select("id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256")).join(gone, same, "left_anti")
    if with_kept:
        rest = rest.withColumns({"n_bytes": F.octet_length("text").cast("long"), "kept_sha256": F.sha2("text", 256)})
    rest = rest.select("id", "h", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.array().cast("array<struct<start:long,end:long>>").alias("spans"), *([F.col("text").cast("binary").alias("kept")] if with_kept else []))
    return changed.unionByName(rest).withColumnsRenamed({"id": id_col, "h": "text_hash"})
