"""Alignment, fill-in-middle and token counts against plain Python over the libraries, on odd texts and on whole registered queries."""

import collections
import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lotwise.llm import alignment, bpe, fill_middle, queries, segments, token_counts

SF = "/root/testdata/sf0.001"
BYTES, PIECES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [
    None, "", " ", "  ", "a ", "a  b", " a", "\n x", "x\n y", "▁", "a▁b c", "a ▁ b", "\0 \0a", "<s> </s> <0x41>", "<|endoftext|> a", " <unk>", "中文字符" * 300, "a" * 5000,
    "é　 x", "👩‍👩‍👧 ok", "ǅ ǆ​ x", "x \x85 y z", "don't 's ''s !'s", "abć d", "\x1c a \x1f b", "<P>a<S>", "a <P b", "tail\n", "1234567890 " * 40,
]


@pytest.fixture(scope="module")
def library():
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    return a, b


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(None, "no id"), (3, ODD[3]), (7, "another text of an id"), (None, "no id")]
    return spark.createDataFrame([(*r, "x", "y")[:4] for r in rows], "doc_id long, text string, form string, chunk string").repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def source(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# --- alignment


def tokens(library, text):
    """Bytes and ids of both sides, or nothing if their bytes are not the text's."""
    a, b = library
    letters = {c: i for i, c in enumerate(bpe.byte_letters())}
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    whole = (" " + text).encode()
    return (list(zip(ia, ba)), list(zip(ib, bb))) if text and b"".join(ba) == whole == b"".join(bb) else ([], [])


def brute_alignment(library, texts):
    found, held, top = [], collections.Counter(), collections.Counter()
    for text in texts:
        a, b = tokens(library, text)
        owner = [k for k, (_, x) in enumerate(b) for _ in x]
        ends_a, ends_b = (list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b))
        place = {e: j for j, e in enumerate(ends_b)}
        links, groups, starts, la, lb = [], [], 0, 0, 0
        for k, e in enumerate(ends_a):
            links += [(a[k][0], b[o][0]) for o in sorted(set(owner[starts:e]))]
            starts = e
            if e in place:
                j = place[e] + 1
                groups.append(",".join(str(i) for i, _ in a[la : k + 1]) + "|" + ",".join(str(i) for i, _ in b[lb:j]))
                la, lb = k + 1, j
        held.update(set(links))
        found.append((len(a), len(b), groups, links))
    for (x, _), c in held.items():
        top[x] = max(top[x], c)
    return [(na, nb, len(g), len(ls), sum(held[p] == top[p[0]] for p in ls), sum(held[p] for p in ls), sha(";".join(g)) if na else "") for na, nb, g, ls in found]


def test_alignment(spark, odd, library):
    docs = source(odd)
    want = collections.Counter((i, *w) for (i, _), w in zip(docs, brute_alignment(library, [t for _, t in docs])))
    assert rows_of(alignment.link_statistics(odd, BYTES, PIECES)) == want
    assert alignment.link_statistics(odd.limit(0), BYTES, PIECES).count() == 0


def test_alignment_query(spark, library):
    docs = source(queries.read(spark, SF, "documents"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_alignment(spark, SF).collect()}
    assert [got[i] for i, _ in docs] == brute_alignment(library, [t for _, t in docs]) and len(got) == len(docs)


def test_alignment_of_small_chunks(spark, library, monkeypatch):
    """Counts reach over chunks: every document in one of its own."""
    texts = ["the cat sat", "the cat", "naïve the", "▁", "", "cat the cat"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.link_statistics(docs, BYTES, PIECES).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(library, texts)


def test_aligned_texts(spark, library):
    texts = ["unbelievable naïve 👩‍👩", "", "a▁b", "two words"]
    for r in alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, PIECES).collect():
        a, b = tokens(library, texts[r.doc_id])
        assert (r.ids_a, r.ids_b) == ([i for i, _ in a], [i for i, _ in b])
        spans = [[(sum(len(x) for _, x in s[:k]), sum(len(x) for _, x in s[: k + 1])) for k in range(len(s))] for s in (a, b)]
        want = [(i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if min(x[1], y[1]) > max(x[0], y[0])]
        assert [tuple(x) for x in r.links] == want
        assert r.n_shared == sum(g.a * g.b for g in r.groups) and sum(g.a for g in r.groups) == len(a) and sum(g.b for g in r.groups) == len(b)


def test_alignment_is_bounded_in_memory(monkeypatch):
    """A part of all distinct words, laid over bytes some words at a time: the links are those of one matrix, memory under 120 bytes for each of text (167 before)."""
    a, b = segments.byte_level(BYTES), segments.pieces(PIECES)
    rng = random.Random(5)
    words = pa.array([" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(120_000))])
    cut = segments.split(words)
    alignment.Aligned(a, b, segments.split(words.slice(0, 0)))
    tracemalloc.start()
    of = alignment.Aligned(a, b, cut)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 120 * len(words[0].as_py())
    few = segments.listed(["the naïve cat", "", None, "中文字符 x"])
    for block in (1, 5, 1 << 22):
        monkeypatch.setattr(alignment, "BLOCK", block)
        got = alignment.Aligned(a, b, few).overlaps
        found = [got.ptr.tolist(), got.columns.tolist(), got.values.tolist(), got.width]
        want = found if block == 1 else want
        assert found == want
    assert len(of.overlaps) == len(of.ids[0]) and of.overlaps.values.sum() == cut.sizes.sum()


@pytest.mark.parametrize("block", [1, 7, 1 << 22])
def test_sparse_products(block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = np.random.default_rng(1)
    for n, k, m in ((0, 3, 2), (1, 1, 1), (5, 4, 6), (9, 9, 3), (4, 0, 4)):
        x, y = rng.integers(0, 3, (n, k)), rng.integers(0, 3, (k, m))

        def csr(d):
            return alignment.Csr(np.concatenate([[0], np.cumsum((d > 0).sum(1))]).astype(np.int64), np.nonzero(d)[1], d[d > 0], d.shape[1])

        def dense(c):
            out = np.zeros((len(c), c.width), int)
            for i in range(len(c)):
                out[i, c.columns[c.ptr[i] : c.ptr[i + 1]]] = c.values[c.ptr[i] : c.ptr[i + 1]]
            return out

        assert (dense(csr(x).product(csr(y))) == x @ y).all() and (dense(csr(x).transposed()) == x.T).all()
        assert (csr(x).times(np.arange(k)) == x @ np.arange(k)).all()


# --- fill-in-middle


def brute_fill(doc_id, text):
    n, digest = len(text), sha(f"1:{doc_id}")
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    left, right = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:left], text[left:right], text[right:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, left, right - left, sha(out), sha(text))


@pytest.mark.parametrize("unit", [1, 7, fill_middle.UNIT])
def test_fill_in_middle(spark, odd, unit):
    assert rows_of(fill_middle.fill_in_middle(odd, unit=unit)) == collections.Counter(brute_fill(i, t) for i, t in source(odd))
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_marks_across_pieces():
    """Texts that end as a mark begins, cut anywhere, are found again from output and form."""
    for text in ("a<", "<", "<<P", "ab<S", "<M<", "x<P<S<M", "é<" * 5):
        for left in range(len(text) + 1):
            for right in range(left, len(text) + 1):
                for form in ("psm", "spm"):
                    how = fill_middle.Cut(len(text), form, left, right)
                    reader, parts = fill_middle.Restorer(form), []
                    for piece in fill_middle.output_pieces(text, how, 1):
                        for k in range(len(piece)):
                            parts += reader.feed(piece[k : k + 1])
                    parts += reader.feed(b"", last=True)
                    assert b"".join(d for _, d in sorted(parts, key=lambda x: x[0])).decode() == text


def test_fill_in_middle_query(spark):
    docs = source(queries.read(spark, SF, "documents"))
    assert rows_of(queries.op12_fill_in_middle(spark, SF)) == collections.Counter(brute_fill(i, t) for i, t in docs)


def test_fill_in_middle_shuffles_once(spark, odd):
    plan = fill_middle.fill_in_middle(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("Exchange hashpartitioning") == 1


# --- token counts


@pytest.mark.parametrize("path", [PIECES, BYTES, WORDS])
def test_token_counts(spark, odd, path):
    if path == PIECES:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want = collections.Counter((i, len(t.encode()), count(t), count(t) > 50) for i, t in source(odd))
    assert rows_of(token_counts.count_tokens(odd, path, limit=50)) == want
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0


def test_long_texts_are_cut_at_safe_boundaries(monkeypatch, library):
    monkeypatch.setattr(token_counts, "LONG_SEGMENT", 50)
    counter, rng = token_counts.PieceCounter(PIECES), random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(700)) for letters in ("中文字符的一是", "abc", "0123456789", "a 字b", "ğé▁x", "👩‍ ok") for _ in range(8)]
    of = counter.segments(pa.array(texts))
    counts = np.concatenate([[0], np.cumsum(counter.lengths(of)[of.codes])])[of.bounds]
    assert np.diff(counts).tolist() == [len(library[1].encode(t)) for t in texts]
    assert any(len(counter.cuts(t)) > 3 for t in texts)


def test_token_counts_query(spark, library):
    docs = source(queries.read(spark, SF, "documents"))
    want = collections.Counter((i, len(t.encode()), n := len(library[1].encode(t)), n > 4096) for i, t in docs)
    assert rows_of(queries.op13_token_counts(spark, SF)) == want


def test_segments_are_those_of_the_pattern():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab  \n\t▁　é\x1c") for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None]
    of = segments.split(pa.array(texts))
    got = [[of.texts[c] for c in of.codes[s:e]] for s, e in zip(of.bounds, of.bounds[1:])]
    assert got == [segments.SAFE.split(t) if t else [] for t in texts]
