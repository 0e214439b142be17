"""Numbers of tokens without the tokens: batches balanced by bytes, long texts cut at safe boundaries."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lotwise.llm import segments, words

LIMIT = 4096
#: Bytes of text that are cut and counted at once.
BATCH_BYTES = 8 << 20
#: Characters from which a segment without a safe space is cut between two characters that no piece holds side by side.
LONG_SEGMENT = 1 << 14


class PieceCounter:
    """Counts for a piece vocabulary, the same as encoding whole texts."""

    def __init__(self, path: str):
        self.vocabulary = segments.pieces(path)

    def segments(self, texts: pa.Array) -> segments.Segments:
        return segments.split(texts) if self.vocabulary.safe else segments.listed(texts.to_pylist(), lambda t: [t])

    def cuts(self, segment: str) -> list[str]:
        """Parts of a long segment: no piece holds the two characters around a cut, nor a blank and the one after it."""
        pairs, blank, out, start, at = self.vocabulary.pairs, segments.BLANK, [], 0, LONG_SEGMENT
        while at < len(segment):
            left, right = segment[at - 1], segment[at]
            if " " not in (left, right) and left + right not in pairs and blank + right not in pairs and right != blank != left:
                out.append(segment[start:at])
                start, at = at, at + LONG_SEGMENT
            else:
                at += 1
        return [*out, segment[start:]]

    def lengths(self, of: segments.Segments) -> np.ndarray:
        long = {s: k for k, (s, n) in enumerate(zip(of.texts, of.sizes)) if n > LONG_SEGMENT}
        short = segments.Segments(pc.if_else(pa.array(of.sizes > LONG_SEGMENT), "", of.distinct), of.codes, of.bounds) if long else of
        counts = np.diff(segments.encode(self.vocabulary, short)[1])
        for s, k in long.items():  # each part but the first has one token too many, the blank put before it
            parts = self.cuts(s) if self.vocabulary.safe else [s]
            counts[k] = sum(len(self.vocabulary.one(p)) for p in parts) - (len(parts) - 1)
        return counts


class FileCounter:
    """Counts for a vocabulary file of the other library, special strings in texts being special tokens as is its default."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec["added_tokens"])
        #: Byte-level words begin at a space; a text's first word has none before it.
        self.splits = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not spec["normalizer"] and plain

    def cut(self, text: str) -> list[str]:
        if not self.splits:
            return [text]
        first, *rest = segments.SAFE.split(text)
        return [first, *(" " + r for r in rest)]

    def segments(self, texts: pa.Array) -> segments.Segments:
        return segments.listed(texts.to_pylist(), self.cut)

    def lengths(self, of: segments.Segments) -> np.ndarray:
        distinct = of.texts
        return np.fromiter((len(e.ids) for k in range(0, len(distinct), 256) for e in self.library.encode_batch(distinct[k : k + 256], add_special_tokens=False)), np.int64, len(distinct))


@functools.cache
def counter(path: str) -> PieceCounter | FileCounter:
    """One for each Python worker."""
    return PieceCounter(path) if path.endswith(".model") else FileCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, in one pass without a shuffle.

    `path` names a vocabulary on every executor: `.model` for pieces, `.json`
    for the other library; no begin, end or added special tokens, no limit on
    length.  Only numbers leave the Arrow function.  A batch is taken in parts
    of about BATCH_BYTES, its texts are cut at safe boundaries, and each
    distinct segment of a part is encoded once, so memory is bounded by a part
    or by the longest text.  A null text is empty: no bytes, no tokens.  Rows
    are independent: repeated rows and null ids give a row each; an empty
    table gives none.  Only the id and the text are read; other columns may
    have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in (c for b in batches for c in words.chunks(b, size=BATCH_BYTES)):
            of = count.segments(part.column(1))
            total = np.concatenate([[0], np.cumsum(count.lengths(of)[of.codes])])[of.bounds]
            n = np.diff(total)
            yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.fill_null(pc.binary_length(part.column(1)), 0), pa.int64()), pa.array(n), pa.array(n > limit)], names)

    rows = docs.select(id_col, text_col)
    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
