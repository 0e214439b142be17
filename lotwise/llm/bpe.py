"""Byte-pair encoding with a contiguous array of ranks, and decoding.

For a word, `parts` holds the ids between boundaries and `ranks` the merge rank
of each adjacent pair.  The smallest rank is sought by scanning, its boundary is
deleted and the two neighbouring ranks are refreshed.  Scanning is quadratic, so
words of more than LONG_WORD parts use a heap with the same order of merges.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lotwise.llm import words

LONG_WORD = 96
NONE = 1 << 60

#: Words kept with their ids, twice: when the newer table is full it replaces the older one, so memory stays bounded.
CACHED_WORDS = 150_000

CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
ANY_WORD = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{{L}}\p{{N}}]+")
#: The same for texts of characters up to U+00FF.
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORD = re.compile(rf"{CONTRACTIONS}|[{_L}]+|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file with word-end marks, lower case, and white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        end, ids, letters = model["end_of_word_suffix"], self.vocab, byte_letters()
        self.inner, self.last = [ids[c] for c in letters], [ids[c + end] for c in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merge(self, parts: list[int]) -> list[int]:
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        get, none = self.merges.get, (NONE, 0)
        ranks = [get(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] = get((parts[i], parts[i + 1]))[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)[0]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)[0]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, m[1], parts[i], parts[i + 1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (m := get((parts[left], parts[right]))):
                    heapq.heappush(heap, (m[0], left, m[1], parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def word_ids(self, word: str) -> list[int]:
        found = self.cache.get(word)
        if found is None:
            if (found := self.older.get(word)) is None:
                raw = word.encode()
                found = self.merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])
            if len(self.cache) >= CACHED_WORDS:
                self.cache, self.older = {}, self.cache
            self.cache[word] = found
        return found

    @staticmethod
    def words(text: str) -> list[str]:
        """The pieces of a text between special tokens, after normalisation."""
        try:
            text.encode("latin-1")
            return LATIN_WORD.findall(text.lower())
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text)
            return ANY_WORD.findall((text.replace("Σ", "σ") if "Σ" in text else text).lower())

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.split_special.split(text) if self.split_special and "<|" in text else (text,)):
            if k % 2:
                ids.append(self.special[part])
            else:
                for w in self.words(part):
                    ids += self.word_ids(w)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder, so tokens are joined by a space; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@functools.cache
def tokenizer(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)


def gathered(starts: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions of the ids of each code in turn, where code c has counts[c] ids from starts[c] on."""
    n = counts[codes]
    out = np.repeat((starts[codes] - np.concatenate([[0], np.cumsum(n)])[:-1]).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text: (id, n_tokens, [ids,] ids_sha256, decoded_sha256).

    ids_sha256 is of the decimal ids joined by a space, decoded_sha256 of the
    decoded text.  A null text is empty: no ids, and the digests of nothing.
    Rows are independent, so repeated rows give repeated results, null ids too;
    an empty table gives no rows.  A very long text is encoded whole, alone in
    its chunk.  Only the id and the text are read; other columns may have any
    name.  `path` must name the vocabulary file on every executor.  A batch's distinct words are
    encoded once; white space always ends a word in this kind of vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part in (c for b in batches for c in words.chunks(b)):
            distinct, codes, bounds = words.split(part.column(1))
            encoded = [bpe.encode(w) for w in distinct.to_pylist()]
            counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
            if not counts.all():  # words without ids leave no gap
                keep = counts[codes] > 0
                bounds, codes = np.concatenate([[0], np.cumsum(keep)])[bounds], codes[keep]
            total = np.concatenate([[0], np.cumsum(counts[codes])])[bounds]

            def joined(texts: list[str]) -> Iterator[bytes]:
                lists = pa.LargeListArray.from_arrays(bounds, pa.array(texts, pa.large_string()).take(pa.array(codes)))
                return (x.as_buffer() for x in pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()))

            columns = [part.column(0), pa.array(np.diff(total), pa.int64())]
            if with_ids:
                flat, starts = np.fromiter((i for e in encoded for i in e), np.int32), np.concatenate([[0], np.cumsum(counts)])
                columns.append(pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(flat[gathered(starts, counts, codes)])))
            columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in joined([" ".join(map(str, e)) for e in encoded])], pa.string()))
            columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in joined([bpe.decode(e) for e in encoded])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(id_col, text_col)
    names = [id_col, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string")
