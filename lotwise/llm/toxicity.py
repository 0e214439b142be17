"""Toxicity: maximal scoring segments of token log-odds, with extreme-value statistics.

A token's score is the log of its rate in toxic texts over its rate elsewhere,
both smoothed with a Dirichlet prior whose mean is the corpus, less a drift that
makes ordinary text negative.  The scan of Ruzzo and Tompa finds all maximal
segments in linear time.  A segment of score S in a text of n tokens is as
unusual as K n exp(-lambda S) says (Karlin and Altschul); the surprise of all
significant segments is summed, and a logistic curve turns the sum into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import words
from lotwise.llm.quality import held_out, sampled

BUCKETS = 1 << 18

#: A token is known by its first characters, then by more of them, then whole: an unseen word scores as its beginning does.
LEVELS = (4, 6, None)

#: Labelled rows that are learned from, at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 40_000

#: Tokens that the prior of a bucket counts for: a few, and a share of the toxic ones dealt as in the corpus.
PRIOR, PRIOR_SHARE = 1.0, 0.05

#: Taken from every token's score.
DRIFT = 0.5

EDGES = " .,;:!?\"'()[]{}<>*_-#%&$|/\\"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (level x distinct token), the codes of each text's tokens, and bounds: words in lower case without marks at their ends."""
    distinct, codes, bounds = words.split(pc.utf8_lower(pc.fill_null(texts, "")))
    plain = pc.utf8_trim(distinct, EDGES)
    levels = [words.hashes(plain if n is None else pc.utf8_slice_codeunits(plain, 0, n)) % np.uint64(BUCKETS) for n in LEVELS]
    return np.stack(levels).astype(np.int64), codes, bounds


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa, in linear time; only positive scores are visited.

    Each candidate keeps the place of the last one before it whose sum up to its
    start is lower, and the search goes from one such to the next.  Where none
    is lower, all candidates are maximal and done.
    """
    before = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    done: list[tuple[int, int, float]] = []
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before the start, sum to the end, last lower one
    for i, left, right in zip(at.tolist(), before[at].tolist(), before[at + 1].tolist()):
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0:
                done += [(s, e, r - l) for s, e, l, r, _ in found]
                found.clear()
                break
            if found[j][3] >= right:
                break
            start, left, lower = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = lower
        found.append((start, i + 1, left, right, j))
    return done + [(s, e, r - l) for s, e, l, r, _ in found]


@dataclass
class Model:
    toxic: np.ndarray  # counts by level and bucket
    other: np.ndarray  # the same, scaled to as many tokens
    prior: np.ndarray
    rate: float = 1.0  # lambda
    ln_k: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, buckets: np.ndarray) -> np.ndarray:
        """Log-odds of tokens; each level's Dirichlet prior has the odds of the level above as its mean."""
        odds = np.ones(buckets.shape[1])
        for level, at in enumerate(buckets):
            weight = self.prior[level, at]
            odds = (self.toxic[level, at] + weight * odds) / (self.other[level, at] + weight)
        return np.log(odds) - DRIFT

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments of a text: word positions, and the surprise of each in nats."""
        bar = self.ln_k + np.log(max(1, len(scores)))
        return [(s, e, self.rate * x - bar) for s, e, x in segments(scores) if self.rate * x > bar]

    def score(self, surprise: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(surprise) + self.shift, -30, 30)))


def counted(everywhere: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> Model:
    total = max(1.0, float(toxic[0].sum()))
    share = everywhere / np.maximum(1.0, everywhere.sum(1, keepdims=True))
    scale = total / max(1.0, float(other[0].sum()))
    return Model(*(x.astype(np.float32) for x in (toxic, other * scale, PRIOR + PRIOR_SHARE * total * share)))


def gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and ln K of the highest segments of clean texts of n tokens, by maximum likelihood over a grid of lambda."""
    found = []
    for rate in np.geomspace(0.05, 5, 120):
        z = rate * best - np.log(n)
        low = z.min()
        ln_k = low - np.log(np.exp(low - z).mean())
        found.append((-len(z) * np.log(rate) + (z - ln_k).sum() + np.exp(ln_k - z).sum(), float(rate), float(ln_k)))
    return min(found)[1:]


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_fold: int, sample_rows: int) -> Model:
    """Counts of every document, and labels of at most `sample_rows`; half of these for the log-odds, half to calibrate.

    What comes to the driver is a row for each bucket, and one for each sampled document.
    """
    chosen = F.broadcast(sampled(labels, id_col, label_col, folds, held_fold, sample_rows))
    half = F.pmod(F.xxhash64("labelled", F.lit(1)), F.lit(2))
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen.withColumn("half", half), F.col("id") == F.col("labelled"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(LEVELS) * BUCKETS), np.int64)
        for part in (c for b in batches for c in words.chunks(b)):
            found, codes, bounds = tokens(part.column(1))
            label, half = (np.repeat(pc.fill_null(part.column(i).cast(pa.int64()), -1).to_numpy(), np.diff(bounds)) for i in (0, 2))
            learned = half == 0
            for k, which in enumerate((slice(None), learned & (label == 1), learned & (label == 0))):
                n = np.bincount(codes[which], minlength=found.shape[1])
                for level, at in enumerate(found):
                    sums[k, level * BUCKETS : (level + 1) * BUCKETS] += np.bincount(at, n, BUCKETS).astype(np.int64)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *sums[:, at])], ["bucket", "n", "toxic", "other"])

    counts = marked.select("label", "text", "half").mapInArrow(count, "bucket long, n long, toxic long, other long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "other")]).toArrow()
    sums = np.zeros((3, len(LEVELS) * BUCKETS))
    sums[:, counts.column("bucket").to_numpy()] = [counts.column(c).to_numpy() for c in ("n", "toxic", "other")]
    model = counted(*sums.reshape(3, len(LEVELS), BUCKETS))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (c for b in batches for c in words.chunks(b)):
            found, codes, bounds = tokens(part.column(1))
            scores = shared.value.scores(found)[codes]
            own = [[s for _, _, s in segments(scores[a:b])] for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(own, pa.list_(pa.float64()))], ["label", "n", "parts"])

    rows = marked.where("half = 1").select("label", "text").mapInArrow(scan, "label long, n long, parts array<double>").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["n"]), key=lambda r: (r["label"], r["n"], r["parts"]))  # tasks end in any order
    clean = [(max(r["parts"]), r["n"]) for r in rows if not r["label"] and r["parts"]]
    if len(clean) > 1:
        model.rate, model.ln_k = gumbel(*np.array(clean, float).T)
    for r in rows:
        r["parts"] = [model.rate * p for p in r["parts"]]
    x = np.log1p(np.array([sum(max(0.0, p - model.ln_k - np.log(r["n"])) for p in r["parts"]) for r in rows]))
    y = np.array([r["label"] for r in rows], float)
    if len(rows) and 0 < y.sum() < len(y):
        model.slope, model.shift = logistic(x, y)
    else:
        model.shift = -1.0
    return model


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's method for one variable and a constant, lightly damped."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        w += np.clip(np.linalg.solve(h, a.T @ (y - p) - ridge * w), -2, 2)
    return float(w[0]), float(w[1])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_fold: int = 0, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, held_out, score, predicted, passages) of every document; passages are spans of words and their surprise.

    Labels of ids with crc32(id) mod `folds` = `held_fold` are not learned from.
    Null and empty texts have no segment and the lowest score.  Very long texts
    are scanned whole, in linear time.  Rows are scored one by one, repeated ones
    alike; a null id is not held out; an empty table gives no rows.  Without
    labels every score is below the threshold.  Only the id and the text of
    `docs`, and the id and the label of `labels`, are read; other columns may
    have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, folds, held_fold, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (c for b in batches for c in words.chunks(b)):
            model, (found, codes, bounds) = shared.value, tokens(part.column(1))
            scores = model.scores(found)[codes]
            spans = [model.passages(scores[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            total = np.array([sum(x for _, _, x in p) for p in spans], float)
            passages = [[{"start": s, "end": e, "surprise": x} for s, e, x in p] for p in spans]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(total)), pa.array(passages, kind)], [id_col, "score", "passages"])

    rows = docs.select(id_col, text_col)
    scored = rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double, passages array<struct<start:int,end:int,surprise:double>>")
    return scored.select(id_col, held_out(F.col(id_col), folds, held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
