"""Lexicons: all entries sought in one pass over a text by an Aho-Corasick automaton."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Lexicon:
    """Entries, and the negations that cancel one of their occurrences."""

    def __init__(self, entries: tuple[str, ...], negations: tuple[str, ...], negated_after: str | None, token: str, reach: int):
        self.automaton = ahocorasick.Automaton()
        own = frozenset(negations)
        for e in entries:
            self.automaton.add_word(e, (e, e.split(" ")[0] in own))
        self.some = bool(entries)
        if self.some:
            self.automaton.make_automaton()
        self.negations, self.reach = own, reach
        self.token = re.compile(token)
        self.after = re.compile(negated_after.removeprefix("(?U)").removeprefix("^")) if negated_after else None

    def hits(self, low: str) -> list[str]:
        """Entries with an occurrence that stands, in order; occurrences of one entry do not overlap."""
        found: set[str] = set()
        ends: dict[str, int] = {}
        tokens: tuple[list[int], list[str]] | None = None
        for last, (entry, free) in self.automaton.iter(low) if self.some else ():
            end, start = last + 1, last + 1 - len(entry)
            if entry in found or start < ends.get(entry, 0):
                continue
            ends[entry] = end
            if self.after and self.after.match(low, end):
                continue
            if self.negations and not free:
                if tokens is None:
                    spans = [m.span() for m in self.token.finditer(low)]
                    tokens = [s for s, _ in spans], [low[s:e] for s, e in spans]
                k = bisect_left(tokens[0], start)
                before = tokens[1][max(k - self.reach, 0) : k]
                if before and (cut := low[tokens[0][k - 1] : start]) != before[-1] and len(cut) < len(before[-1]):
                    before[-1] = cut  # the entry begins within this token
                if not self.negations.isdisjoint(before):
                    continue
            found.add(entry)
        return sorted(found)


@functools.cache
def lexicon(*key) -> Lexicon:
    """One for each Python worker and lexicon."""
    return Lexicon(*key)


def lexicon_hits(text: Column, entries: list[str], negations: list[str], negated_after: str | None, token: str = "[а-яё0-9%]+", reach: int = 2) -> Column:
    """Sorted entries with an occurrence in the lower-cased text that no negation cancels; none for null.

    A negation cancels within the `reach` tokens before an occurrence, unless
    the entry begins with one itself, or by the pattern right after it.  One
    automaton serves a worker, and a batch's distinct texts are read once each,
    in time that does not depend on the number of entries.
    """
    key = tuple(entries), tuple(negations), negated_after, token, reach

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        words = lexicon(*key)
        coded = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).dictionary_encode()
        found = pa.array([words.hits(t or "") for t in coded.dictionary.to_pylist()], pa.list_(pa.string()))
        return found.take(coded.indices)

    return run(F.lower(F.coalesce(text, F.lit(""))))
