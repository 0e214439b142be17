"""Quality classifier: a factorisation machine over hashed words, structure statistics and their bins.

The pairwise part, sum over i < j of <v_i, v_j> x_i x_j, is computed in linear
time as half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm import words

WORD_BUCKETS = 1 << 16
BINS = 16

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 12_000

FACTORS, EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 8, 6, 800, 64, 0.05, 1e-5, 7

STATISTICS = ("distinct", "top", "again", "upper", "digits", "marks", "odd_marks", "word_chars", "lines", "line_again", "long_words", "words")


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


UPPER_BYTE, DIGIT_BYTE = _byte_class((65, 90)), _byte_class((48, 57))
MARK_BYTE = _byte_class((33, 47), (58, 64), (91, 96), (123, 126))
ODD_MARK_BYTE = MARK_BYTE & ~np.isin(np.arange(256), [ord(c) for c in ".,;:'\"-()?"])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, features, values): for each text its words, with unit length, then its binned statistics.

    Statistics are of the text alone: repetition of words, of neighbours and of
    lines, shares of kinds of characters, and lengths.  A text without words has
    the statistics of nothing, all 0.
    """
    texts = pc.fill_null(texts, "")
    distinct, codes, bounds = words.split(pc.utf8_lower(texts))
    n_docs, n = len(bounds) - 1, np.diff(bounds)
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), n)
    bucket = (words.hashes(distinct) % np.uint64(WORD_BUCKETS)).astype(np.int32)
    keys, counts = np.unique(doc * np.int64(len(distinct) + 1) + codes, return_counts=True)
    word_doc, word = (keys // (len(distinct) + 1)).astype(np.int32), (keys % (len(distinct) + 1)).astype(np.int32)
    del keys
    value = np.sqrt(counts)
    value /= np.sqrt(np.maximum(np.bincount(word_doc, counts, n_docs), 1e-9))[word_doc]

    full = np.maximum(n, 1)
    top = np.zeros(n_docs)
    np.maximum.at(top, word_doc, counts)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    edges = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + n_docs + 1].astype(np.int64)
    size = np.maximum(np.diff(edges), 1)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[raw[edges[0] : edges[-1]]])])
        return np.diff(sums[edges - edges[0]]) / size

    lines = pc.split_pattern(texts, "\n")
    line_doc = pc.list_parent_indices(lines).to_numpy()
    line_codes = pc.list_flatten(lines).dictionary_encode()
    line_keys = np.unique(line_doc * np.int64(len(line_codes.dictionary) + 1) + line_codes.indices.to_numpy())
    n_lines = np.bincount(line_doc, minlength=n_docs)
    chars = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int32)
    stats = {
        "distinct": np.bincount(word_doc, minlength=n_docs) / full,
        "top": top / full,
        "again": np.bincount(doc, again, n_docs) / full,
        "upper": share(UPPER_BYTE),
        "digits": share(DIGIT_BYTE),
        "marks": share(MARK_BYTE),
        "odd_marks": share(ODD_MARK_BYTE),
        "word_chars": np.bincount(doc, chars[codes], n_docs) / full / 20,
        "lines": n_lines / full,
        "line_again": 1 - np.bincount(line_keys // (len(line_codes.dictionary) + 1), minlength=n_docs) / np.maximum(n_lines, 1),
        "long_words": np.bincount(doc, chars[codes] > 14, n_docs) / full,
        "words": np.log1p(n) / 12,
    }
    table = np.stack([stats[s] for s in STATISTICS], 1)
    bins = np.minimum(np.sqrt(np.clip(table, 0, 1)) * BINS, BINS - 1).astype(np.int64)
    stat_ids = WORD_BUCKETS + np.arange(len(STATISTICS)) * BINS + bins
    k = len(STATISTICS)
    per_doc = np.bincount(word_doc, minlength=n_docs) + k
    out_bounds = np.concatenate([[0], np.cumsum(per_doc)])
    ids, values = np.zeros(out_bounds[-1], np.int32), np.zeros(out_bounds[-1], np.float32)
    at = np.arange(len(word)) + k * word_doc
    ids[at], values[at] = bucket[word], value
    tail = (out_bounds[1:, None] - k + np.arange(k)).reshape(-1)
    ids[tail], values[tail] = stat_ids.reshape(-1), 0.3
    return out_bounds, ids, values


N_FEATURES = WORD_BUCKETS + len(STATISTICS) * BINS


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, bounds: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of documents one after another; each has a feature at least."""
        x = values[:, None]
        vx = self.factors[ids] * x
        total = np.add.reduceat(vx, bounds[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), bounds[:-1])
        return self.bias + np.add.reduceat(self.weights[ids] * values, bounds[:-1]) + ((total * total).sum(1) - squares) / 2

    def score(self, bounds: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(bounds, ids, values).astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> FactorisationMachine:
    """Minimise the log loss with Adagrad, each step over a batch of rows."""
    rng = np.random.default_rng(SEED)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, FACTORS)).astype(np.float32))
    g_bias, g_w, g_v = 1e-3, np.full(N_FEATURES, 1e-3, np.float32), np.full((N_FEATURES, FACTORS), 1e-3, np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(labels))) if len(labels) else 0
    for _ in range(min(epochs, 100)):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            ids, x = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
            sizes = np.array([len(rows[i][0]) for i in batch])
            bounds, owner = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.arange(len(batch)), sizes)
            error = ((model.score(bounds, ids, x) - labels[batch]) / len(batch)).astype(np.float32)
            v = model.factors[ids]
            total = np.add.reduceat(v * x[:, None], bounds[:-1], axis=0)
            dv = (error[owner] * x)[:, None] * (total[owner] - v * x[:, None])
            used, where = np.unique(ids, return_inverse=True)
            dw = np.bincount(where, error[owner] * x, len(used)).astype(np.float32) + DECAY * model.weights[used]
            dv = np.stack([np.bincount(where, dv[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + DECAY * model.factors[used]
            g_bias += float(error.sum()) ** 2
            g_w[used] += dw * dw
            g_v[used] += dv * dv
            model.bias -= RATE * float(error.sum()) / g_bias**0.5
            model.weights[used] -= RATE * dw / np.sqrt(g_w[used])
            model.factors[used] -= RATE * dv / np.sqrt(g_v[used])
    return model


def crc_of(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary"))


def held_out(id_: Column, folds: int, held_fold: int) -> Column:
    """Whether a row is never learned from; one without an id is not held out."""
    return F.coalesce(F.pmod(crc_of(id_), F.lit(folds)) == held_fold, F.lit(False))


def sampled(labels: DataFrame, id_col: str, label_col: str, folds: int, held_fold: int, rows: int) -> DataFrame:
    """(labelled, label): at most `rows` ids that may be learned from, and one label for each (the largest, if they differ)."""
    known = labels.select(F.col(id_col).alias("labelled"), F.col(label_col).alias("label")).where("labelled is not null and label is not null")
    usable = known.where(~held_out(F.col("labelled"), folds, held_fold)).groupBy("labelled").agg(F.max("label").alias("label"))
    return usable.orderBy(F.xxhash64("labelled"), "labelled").limit(rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_fold: int = 2, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fit on at most `sample_rows` labelled documents, the whole text of each; only hashed features come to the driver.

    These take 8 bytes for each distinct word of a document, and as there are
    WORD_BUCKETS of them no document gives more than 0.5 MB (documents of 300
    distinct words: 30 MB for 12,000 rows).  Give fewer `sample_rows` where
    documents are whole books.
    """
    chosen = F.broadcast(sampled(labels, id_col, label_col, folds, held_fold, sample_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(chosen, F.col("id") == F.col("labelled")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (c for b in batches for c in words.chunks(b)):
            bounds, ids, values = features(part.column(1))
            at = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(values))], ["label", "ids", "x"])

    found = rows.mapInArrow(run, "label int, ids array<int>, x array<float>").toArrow()
    ids, x = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (found.column("ids"), found.column("x")))
    at, flat_ids, flat_x = ids.offsets.to_numpy(), ids.values.to_numpy(), x.values.to_numpy()
    pairs = [(flat_ids[a:b], flat_x[a:b]) for a, b in zip(at[:-1], at[1:])]
    y = found.column("label").to_numpy().astype(np.float32)
    pairs = [(i[o], v[o]) for i, v in pairs for o in (np.lexsort((v, i)),)]
    order = sorted(range(len(y)), key=lambda k: (pairs[k][0].tobytes(), pairs[k][1].tobytes(), y[k]))  # tasks end in any order
    return fit([pairs[i] for i in order], y[order])


def scored(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", score_col: str = "score", least: float | None = None) -> DataFrame:
    """`docs` with the score of every whole text, null and empty ones too, in a further column.

    With `least`, only the rows that score as much come back from the Python
    workers, and without the further column.  All columns pass, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (c for b in batches for c in words.chunks(b, at)):
            scores = shared.value.score(*features(part.column(at)))
            if least is None:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names)
            else:
                yield part.filter(pa.array(scores >= least))

    names = [*docs.columns, *([score_col] if least is None else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *([T.StructField(score_col, T.DoubleType())] if least is None else [])]))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_fold: int = 2, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of every document.

    Labels of ids with crc32(id) mod `folds` = `held_fold` are not learned from.
    Without labels, every score is that of an untrained model.  A null text is
    empty; an empty one, or one without words, has the score of statistics that
    are all 0.  Very long texts are scored whole, alone in their chunk.  Rows are
    scored one by one, repeated ones alike; a null id is not held out; an empty
    table gives no rows.  Only the id and the text of `docs`, and the id and the
    label of `labels`, are read; other columns may have any name.
    """
    model = train(docs, labels, id_col, text_col, label_col, folds, held_fold, sample_rows)
    rows = scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
