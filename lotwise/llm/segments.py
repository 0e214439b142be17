"""Texts cut where no token of a byte-level or a piece vocabulary can reach across.

A space after a character that is no white space starts a new token in both
kinds of vocabulary: the pre-tokeniser of a byte-level one begins a new word
there, and no entry of a piece vocabulary has its blank after another
character.  So a text with a space before it is a row of segments that each
begin with a space, and the tokens of the text are those of its segments.
Distinct segments of a batch are encoded once, many of them in one call.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from lotwise.llm.bpe import byte_letters

BLANK = "▁"
SAFE = re.compile(f" (?<=[^\\s{BLANK}] )")
#: White space of any kind, for the columnar form of the same rule.
WHITE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: Segments that cannot stand in a row with others: nothing, or ending in white space, or with a blank.
ALONE = f"[{WHITE}]$|{BLANK}|^$"
#: Characters that every release of the Unicode tables since 2014 puts in the same class.
OLD_LETTERS = "^[\\x00-\\x{52f}]*$"
#: Bytes of distinct segments that go to the library in one call.
CALL_BYTES = 1 << 15
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class Segments:
    """Distinct segments without their first space; the codes of all texts one after another; each text's bounds among them."""

    def __init__(self, distinct: pa.Array, codes: np.ndarray, bounds: np.ndarray):
        self.distinct, self.codes, self.bounds = distinct, codes, bounds
        self.texts: list[str] = distinct.to_pylist()
        #: Bytes, with the space.
        self.sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def matching(self, pattern: str) -> np.ndarray:
        return pc.match_substring_regex(self.distinct, pattern).to_numpy(zero_copy_only=False)


def coded(flat: pa.Array, bounds: np.ndarray) -> Segments:
    found = flat.dictionary_encode()
    return Segments(found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds)


def listed(texts: list[str | None], cut=SAFE.split) -> Segments:
    """Texts cut by a Python function; a null or empty text has no segment."""
    parts = [cut(t) if t else [] for t in texts]
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    return coded(pa.array(itertools.chain.from_iterable(parts), pa.large_string()), bounds)


def split(texts: pa.Array) -> Segments:
    """Texts cut at safe spaces.  A null or empty text has no segment; " " has one, the space after the space before the text.

    Texts are cut at every space, which is right if no part but the last is
    empty or ends in white space or a blank; the others are cut again by SAFE.
    """
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    flat = pc.list_flatten(lists)
    found = flat.dictionary_encode()
    joins = pc.match_substring_regex(found.dictionary, f"[{WHITE}{BLANK}]$|^$").to_numpy(zero_copy_only=False)[found.indices.to_numpy(zero_copy_only=False)]
    empty = (n == 1) & ~pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    joins[ends - 1] = False
    again = empty | (np.diff(np.concatenate([[0], np.cumsum(joins)])[np.concatenate([[0], ends])]) > 0)
    if not again.any():
        return Segments(found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], ends]))
    others = np.flatnonzero(again)
    parts = [SAFE.split(t) if t else [] for t in texts.take(pa.array(others)).to_pylist()]
    starts, counts = ends - n, n.copy()
    counts[others] = [len(p) for p in parts]
    starts[others] = ends[-1] + np.concatenate([[0], np.cumsum(counts[others])])[:-1]
    both = coded(pa.concat_arrays([flat, pa.array(itertools.chain.from_iterable(parts), pa.large_string())]), np.concatenate([[0], np.cumsum(counts)]))
    both.codes = both.codes[spread(starts, counts)]
    return both


class Pieces:
    """A piece vocabulary (a blank stands for a space and is put before a text)."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(BYTE_PIECE.fullmatch(p)[1], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.size, self.blob = np.array([len(b) for b in self.bytes]), np.frombuffer(b"".join(self.bytes), np.uint8)
        self.blank = self.model.piece_to_id(BLANK)
        plain = [p for i, p in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.pairs = {p[k : k + 2] for p in plain for k in range(len(p) - 1)}
        #: Does a space always end a piece?  If not, texts are encoded whole.
        self.safe = self.model.encode("a b") == self.model.encode("a") + self.model.encode("b") and not any(p[1] == BLANK != p[0] for p in self.pairs)

    def one(self, segment: str) -> list[int]:
        return self.model.encode(segment) if segment else [self.blank]

    def many(self, joined: str, old: bool) -> list[int]:
        return self.model.encode(joined)


class ByteLevel:
    """A byte-level vocabulary; texts get a space before them, and special strings in them are ordinary text.

    Segments of old letters are encoded by the faster of two libraries that
    implement this vocabulary: on them, word classes cannot differ.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        first = spec["pre_tokenizer"] or {}
        self.safe = first.get("type") == "ByteLevel" and first.get("use_regex") and not spec["normalizer"]
        entries = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in special}
        self.bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.size, self.blob = np.array([len(b) for b in self.bytes]), np.frombuffer(b"".join(self.bytes), np.uint8)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        self.library.encode_special_tokens = True
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [bytes([b]) for b in range(256)] + [bytes(letters[c] for c in a + b) for a, b in merges]
        # The other library takes an entry's id for its rank: only a vocabulary whose ids follow its merges can use it.
        ordered = set(map(len, made[:256])) == {1} and len(set(made)) == len(made) == len(entries) and all(self.bytes[256 + k] == b for k, b in enumerate(made[256:]))
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={}) if ordered and self.safe else None

    def one(self, segment: str) -> list[int]:
        return self.many(segment, False)

    def many(self, joined: str, old: bool) -> list[int]:
        if old and self.fast:
            return self.fast.encode_ordinary(" " + joined)
        return self.library.encode(" " + joined, add_special_tokens=False).ids


def joined_bytes(vocabulary: Pieces | ByteLevel, ids: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(vocabulary.size)])[:-1]
    return vocabulary.blob[spread(starts[ids], vocabulary.size[ids])]


@functools.cache
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


@functools.cache
def byte_level(path: str) -> ByteLevel:
    """One for each Python worker."""
    return ByteLevel(path)


def encode(vocabulary: Pieces | ByteLevel, of: Segments) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all distinct segments one after another, and each segment's bounds among them."""
    texts, alone, old = of.texts, of.matching(ALONE) | (not vocabulary.safe), of.matching(OLD_LETTERS)
    counts, order, ids = np.zeros(len(texts), np.int64), [], []

    def put(at: np.ndarray, found: list[int], n: np.ndarray | int) -> None:
        order.append(at)
        ids.append(np.array(found, np.int32))
        counts[at] = n

    for kind in (True, False):
        wanted = np.flatnonzero((old == kind) & ~alone)
        for at in np.split(wanted, np.flatnonzero(np.diff(np.cumsum(of.sizes[wanted]) // CALL_BYTES)) + 1) if len(wanted) else ():
            ends = np.cumsum(vocabulary.size[found := vocabulary.many(" ".join([texts[i] for i in at]), kind)])
            last = np.searchsorted(ends, bounds := np.cumsum(of.sizes[at]))
            if len(ends) and ends[-1] == bounds[-1] and (ends[last] == bounds).all():
                put(at, found, np.diff(last, prepend=-1))
            else:  # bytes are lost: one at a time
                for i in at:
                    put(np.array([i]), found := vocabulary.one(texts[i]), len(found))
    for i in np.flatnonzero(alone):
        put(np.array([i]), found := vocabulary.one(texts[i]), len(found))
    if not order:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    at = np.concatenate(order)
    starts = np.zeros(len(texts), np.int64)
    starts[at] = np.concatenate([[0], np.cumsum(counts[at])])[:-1]
    return np.concatenate(ids)[spread(starts, counts)], np.concatenate([[0], np.cumsum(counts)])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers in all, then those from starts[1] on, and so forth."""
    n = np.cumsum(counts)
    return np.arange(int(n[-1]) if len(n) else 0) + np.repeat(starts - (n - counts), counts)
