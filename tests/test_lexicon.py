"""The automaton against a search entry by entry, and its time against the number of entries."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lotwise.functions import lexicon, text

TOKEN = "[а-яё0-9%]+"


def brute(low, entries, negations, after, reach=2):
    """Each entry by itself: every occurrence, with what is before and after it put together from the text."""
    out = []
    for e in entries:
        at, stands = low.find(e), False
        while at >= 0:
            before = re.findall(TOKEN, low[:at])[-reach:]
            negated = bool(after and re.match(after.removeprefix("(?U)^"), low[at + len(e) :]))
            if e.split(" ")[0] not in negations:
                negated |= bool(set(before) & set(negations))
            stands |= not negated
            at = low.find(e, at + len(e))
        if stands:
            out.append(e)
    return sorted(out)


@pytest.mark.parametrize("entries", [text.DAMAGE, ["аа", "ааа", "не а", "а не"]])
def test_hits_are_those_of_a_search_for_each_entry(spark, entries):
    rng = random.Random(6)
    bits = [*entries, *text.NEGATIONS, "салон", "не требует", "а", "ааааа", ",", ".", "нетбитая", "отсутствуют совсем", "%", "x"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(700)] + [None, "", "НЕ БИТАЯ", "БИТАЯ"]
    for negations, after in ((text.NEGATIONS, text.NEGATED_AFTER), ([], None), (text.NEGATIONS, None)):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
        got = {r.i: r.h for r in df.select("i", text.lexicon_hits(F.col("t"), entries, negations, after).alias("h")).collect()}
        assert [got[i] for i in range(len(texts))] == [brute((t or "").lower(), entries, negations, after) for t in texts]
    assert spark.createDataFrame([("a",)], "t string").select(text.lexicon_hits(F.col("t"), []).alias("h")).first().h == []


def test_time_does_not_grow_with_the_entries():
    rng = random.Random(7)
    low = " ".join("".join(rng.choice("абвгдежз") for _ in range(6)) for _ in range(60_000))
    took = []
    for n in (20, 2000):
        words = lexicon.Lexicon(tuple("".join(rng.choice("клмнопрс") for _ in range(9)) for _ in range(n)), ("не",), None, TOKEN, 2)
        start = time.process_time()
        words.hits(low)
        took.append(time.process_time() - start)
    assert took[1] < 5 * took[0] + 0.05


def test_a_text_of_negated_hits_only_is_linear():
    words = lexicon.Lexicon(("битая",), ("не",), text.NEGATED_AFTER, TOKEN, 2)
    took = []
    for n in (5_000, 40_000):
        start = time.process_time()
        assert words.hits("не битая, " * n) == []
        took.append(time.process_time() - start)
    assert took[1] < 20 * took[0] + 0.1
