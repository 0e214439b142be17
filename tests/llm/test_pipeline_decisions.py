"""Each stage of the pipeline against plain Python, on planted rows."""

import random
import re

import numpy as np
from test_operators import brute_hits, groups

import corpus_pipeline

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnoprstu") for _ in range(RNG.randint(2, 9))) for _ in range(900)]


def prose(n):
    w = [RNG.choice(WORDS) for _ in range(n)]
    return " ".join(f"{x}." if k % 12 == 11 else x for k, x in enumerate(w))


def junk(n):
    return " ".join(RNG.choice(["$$$", "###", "!!!", "0000", "CLICK", "%%", "@@@ 77"]) for _ in range(n))


def planted():
    """(texts by id, labels by id, benchmark items); ids from 1, in this order: prose, junk, copies, passages, leaks."""
    texts = [prose(RNG.randint(60, 160)) for _ in range(160)] + [junk(RNG.randint(60, 160)) for _ in range(160)]
    copies = []
    for t in texts[:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        copies += [" ".join(w), t]
    passage = prose(120)[:500]
    holders = [f"{prose(80)} é{passage}é {prose(80)}" for _ in range(3)]
    item = prose(40)
    leaks = [f"{prose(20)} {item} {prose(20)}", f"{prose(20)} {' '.join(item.split()[4:18])} {prose(500)}"]
    labels = {i + 1: int(i < 160) for i in range(320) if i % 8}
    return dict(enumerate(texts + copies + holders + leaks, 1)), labels, [(1, item), (2, prose(30)), (3, "")]


def near(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: t for i, t in texts.items() if groups(sets, links)[i] == i}


def passages(texts, span=400):
    raws, seen = {i: t.encode() for i, t in texts.items()}, {}
    for b in raws.values():
        for k in range(len(b) - span + 1):
            seen[b[k : k + span]] = seen.get(b[k : k + span], 0) + 1
    out = {}
    for i, b in raws.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = True
        if not gone.all():
            out[i] = bytes(x for x, g in zip(b, gone) if not g).decode(errors="replace")
    return out


def clean(texts, items):
    bad = brute_hits(list(texts.items()), items)
    return {i: t for i, t in texts.items() if not bad[i][3]}


def test_stages_decide_as_plain_python(spark, tmp_path):
    texts, labels, items = planted()
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = {i: t for i, t in texts.items() if not re.match(r"[^a-z]", t)}
    assert len(good) == len(texts) - 160
    want = [("quality", good)]
    want.append(("near-duplicates", near(good)))
    want.append(("repeated passages", passages(want[-1][1])))
    want.append(("decontamination", clean(want[-1][1], items)))
    sizes = [len(w) for _, w in want]
    assert sizes == [189, 165, 165, 164] and sum(want[2][1][i] != want[1][1][i] for i in want[2][1]) == 3
    for name, kept in want:
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
        got = stages[name](spark, docs, str(tmp_path)).collect()
        assert {r.doc_id: r.text for r in got} == kept and len(got) == len(kept), name
        assert all(r.n_chars == len(r.text) for r in got), name
        texts = kept


def test_a_shared_passage_goes_however_few_bytes_it_has(spark, tmp_path):
    """50 words under 400 bytes go from all documents that have them, 49 and a passage that one document repeats stay."""
    rng = random.Random(3)
    short = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    shared, less, own = short(50), short(49), short(51)
    assert len(own) < 400
    rows = [(1, f"ax {shared} bx"), (2, f"cx\n{shared.upper()} dx"), (3, f"ex {less} fx"), (4, f"gx {less} hx"), (5, f"ix {own} jx {own} kx"), (6, f" {shared} ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert got == {1: "ax  bx", 2: "cx\n dx"} | {i: t for i, t in rows if i in (3, 4, 5)}
