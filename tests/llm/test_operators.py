"""Each operator against a brute-force version, on handmade frames with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotwise.llm import bpe, components, decontaminate, embedding_dedup, minhash, quality, suffix_dedup, token_files, toxicity, url_filter, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnoprstuéß") for _ in range(RNG.randint(1, 8))) for _ in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Texts with exact and near copies, shared passages, and odd cases; ids start at 1."""
    rng = random.Random(7)
    base = [text(rng.randint(60, 200), rng) for _ in range(12)]
    passage = text(90, rng)
    out = [*base, base[0], base[1], base[1], None, None, "", " \t\n", "one", "one", "One two", "a" * 3000, "ab" * 900, text(3000, rng)]
    for b in base[:4]:
        for _ in range(6):
            w = b.split()
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    out += [text(20, rng) + " " + passage + " " + text(20, rng) for _ in range(4)] + [passage.upper()]
    return [(i + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "x", -1) for i, t in corpus()], "doc_id long, text string, id string, h string, n long").repartition(3)


def groups(ids, links):
    sets = components.UnionFind()
    for a, b in links:
        sets.union(a, b)
    return {i: sets.find(i) for i in ids}


# --- 1


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    rules = [*url_filter.DEFAULT_RULES, ("b.example.org", "/x", "block"), ("b.example.org", "/x", "allow"), ("example.org", "/", "block"), ("a.b.example.org", "/", "allow"), ("z.com", "/", "block"), ("", "/", "block")]
    hosts = ["example.net", "www.EXAMPLE.net", "org", "fr.org", "b.example.org", "c.a.b.example.org", "xb.example.org", "example.com", "net", "notnet", "a,b.net", "x..net", ".net", "net.", "z.com:80", "ö.org", ""]
    paths = ["", "/", "/en/", "/en", "/de/x?q=://y", "/fr/#f", "/x", "/xy/z", "?a", "#b"]
    urls = [None, "", "no scheme", "://", *[f"http://{h}{p}" for h in hosts for p in paths], *["http://example.net/en/hot"] * 30]
    df = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string").repartition(4)
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(df, url_filter.rules_frame(spark, rules)).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(urls)}
    none = url_filter.filter_urls(df, url_filter.rules_frame(spark, []))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_frame(spark, rules)).count() == 0


def test_urls_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert "Python" not in url_filter.filter_urls(df, url_filter.rules_frame(spark, url_filter.DEFAULT_RULES))._jdf.queryExecution().executedPlan().toString()


# --- 2


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(TOKENIZER), bpe.WordBpe(TOKENIZER)
    odd = ["Hello's World don't  ΣΑΣ <|endoftext|>abc<|startoftext|> ²½ Ⅷ 漢字かな \x1c\x85\xa0 ª º _a_b '", "xyz" * 200 + "é" * 300, "é Å", "a\x1cb c​d", "…!!??''s", "<|endof text|>"]
    for t in odd + [t for _, t in corpus() if t]:
        e = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == e and own.decode(e) == lib.decode(e, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.encode_documents(docs, TOKENIZER).collect()}
    for i, t in corpus():
        e = lib.encode(t or "", add_special_tokens=False).ids
        want = (len(e), e, hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest())
        assert (rows[i].n_tokens, rows[i].ids, rows[i].ids_sha256, rows[i].decoded_sha256) == want
    assert bpe.encode_documents(docs.limit(0), TOKENIZER).count() == 0


def test_long_words_merge_alike():
    own = bpe.WordBpe(TOKENIZER)
    parts = [own.inner[b] for b in ("the quick" * 9).replace(" ", "").encode()]
    assert own._merge_long([*parts]) == own.merge([*parts])


# --- 3 and 4


def labelled(spark, n=600):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.4, rng.random() < 0.3
        t = " ".join([rng.choice(WORDS)] * 40 + ["###"] * 20) if bad else text(rng.randint(20, 120), rng)
        if toxic:
            w = t.split()
            w[5:5] = [rng.choice(["vilerat", "vileone", "nasty", "horrid"]) for _ in range(6)]
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "x y")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([*labels, (n, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    got = quality.quality(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    again = {r.doc_id: r.score for r in quality.quality(docs.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)
    assert quality.quality(docs, labels.limit(0)).count() == 603 and quality.quality(docs.limit(0), labels).count() == 0


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    ids, x = rng.choice(50, 9, replace=False), rng.normal(size=9)
    slow = 0.3 + m.weights[ids] @ x + sum(m.factors[ids[i]] @ m.factors[ids[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    assert math.isclose(m.raw(np.array([0, 9]), ids, x)[0], slow)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert {r.predicted for r in got if r.doc_id in (600, 601)} == {0}
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0} and toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_segments_are_maximal():
    def slow(s):
        """By definition: the best segment, then the same left and right of it."""
        if not len(s) or max(s) <= 0:
            return []
        best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)))
        a = -best[2]
        b = a - best[1]
        return slow(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in slow(s[b:])]

    rng = np.random.default_rng(2)
    for _ in range(60):
        s = rng.integers(-50, 40, 25) + rng.random(25)
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == slow(s.tolist())


def test_segments_are_linear():
    """Ten times the tokens take less than twenty times the time, on sums that fall, rise and swing."""
    rng = np.random.default_rng(8)
    for drift in (-0.5, 0.0, 0.02):
        took = []
        for n in (40_000, 400_000):
            s = rng.normal(drift, 1, n)
            start = time.perf_counter()
            found = toxicity.segments(s)
            took.append(time.perf_counter() - start)
            assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        assert took[1] < 20 * took[0] and took[1] < 10



# --- 5


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if of := windows.get(tuple(w[k : k + n])):
                    hit |= {*range(k, k + n)}
                    found |= of
        out[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, docs, most):
    texts = corpus()
    w = texts[0][1].split()
    items = [(1, " ".join(w[5:40])), (2, " ".join(w[5:17])), (3, " ".join(w[30:43]).upper()), (4, None), (5, ""), (6, "One, two"), (7, "aaa bbb"), (8, " ".join(w[5:40])), (9, "one " * 30), (10, texts[-1][1])]
    more = [(900, "one " * 50), (901, "x " * 400 + " ".join(w[5:18]) + " y" * 3), (None, " ".join(w[:30]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    every = docs.select("doc_id", "text", "id").unionByName(spark.createDataFrame([(i, t, "z") for i, t in more], "doc_id long, text string, id string"))
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in decontaminate.decontaminate(every, bench, broadcast_windows=most).collect()}
    assert got == brute_hits([*texts, *more], items)
    clean = decontaminate.decontaminate(every, bench.limit(0), broadcast_windows=most).collect()
    assert {(r.n_hit, r.contaminated) for r in clean} == {(0, False)} and len(clean) == len(got)
    assert decontaminate.decontaminate(every.limit(0), bench, broadcast_windows=most).count() == 0


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination_by_items_without_id(spark, most):
    """Long and short items without an id count, and are one null among items."""
    long, short = " ".join(WORDS[:20]), " ".join(WORDS[30:35])
    bench = spark.createDataFrame([(None, long), (None, short), (None, short), (7, short)], "item_id long, text string")
    every = spark.createDataFrame([(1, f"x {long} y"), (2, f"x {short} y"), (3, f"{long} {short}"), (4, "x y"), (5, None), (6, f"x {long} {long}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"], key=str), r.contaminated) for r in decontaminate.decontaminate(every, bench, broadcast_windows=most).collect()}
    assert got == {1: (22, 20, [None], True), 2: (7, 5, [7, None], True), 3: (25, 25, [7, None], True), 4: (2, 0, [], False), 5: (0, 0, [], False), 6: (41, 40, [None], True)}


# --- 6 and 7


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), 1000, bits) == ids).all()
    f = token_files.TokenFile(pa.BufferReader(token_files.to_bytes(np.tile(ids, 200), [1, None, 3], [7, 0, 199_993], bits)))
    assert (f.ids(65_530, 131_080) == np.tile(ids, 200)[65_530:131_080]).all()
    assert (f.document(0) == ids[:7]).all() and len(f.document(1)) == 0 and f.doc_ids[1] == token_files.NULL_ID


@pytest.mark.parametrize("vocabulary", [49_408, 1 << 17])
def test_token_files(spark, docs, vocabulary):
    from tokenizers import Tokenizer

    lib, start, want = Tokenizer.from_file(TOKENIZER), 0, {}
    for i, t in corpus():
        e = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (start, len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
        start += len(e)
    got = {r.doc_id: tuple(r)[1:] for r in token_files.round_trip(docs, TOKENIZER, vocabulary, 1).collect()}
    assert got == want
    assert token_files.round_trip(docs.limit(0), TOKENIZER, vocabulary, 1).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "<p>x"), (2, None, "<p>x"), (3, "http://b/ \nc", None), (4, "http://c/", ""), (5, "http://d/", "é" * 300_000), (6, "u", "\r\n\r\n"), (5, "http://d/", "é" * 300_000), (None, "v", "<p>x"), (7, "w", "only")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.write(df, f"file://{tmp_path}/a")).collect()), key=str)
    first = {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(h or "", i)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(i, len((h or "").encode()), digest(h), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))) for i, _, h in pages]
    assert got == sorted(want, key=str)
    large = warc.read(warc.write(df, f"file://{tmp_path}/b", least_bytes=5)).collect()
    assert sum(r.record_type == "revisit" for r in large) == 0
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/c")).count() == 0


def test_warc_random_access():
    b = warc.Bundle()
    raws = {i: warc.record(i, "u", bytes([65 + i % 26]) * 9000, None, False, "2024-01-01T00:00:00Z") for i in range(200)}
    for i, r in raws.items():
        b.add(i, r)
    a = warc.Archive(pa.BufferReader(b.to_bytes()))
    assert len(b.frames) > 3 and all(a.record(i) == raws[i] for i in (0, 57, 199)) and [i for i, _ in a] == [*raws]


# --- 8


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, size, percent):
    sets = {}
    for i, t in corpus():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    parts = groups(sets, links)
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(docs, size=size, percent=percent).collect()}
    assert got == {i: (len(s), parts[i], parts[i] == i) for i, s in sets.items()}
    assert minhash.near_duplicates(docs.limit(0), size=size, percent=percent).count() == 0
    twice = minhash.near_duplicates(docs.where("doc_id = 1").union(docs.where("doc_id = 1")).select("doc_id", "text")).collect()
    assert [(r.component_id, r.kept) for r in twice] == [(1, True)] * 2


def test_near_copies_without_a_centre(spark):
    """Versions that each differ a little from the one before: only neighbours are linked."""
    rng = random.Random(9)
    w, rows = text(200, rng).split(), []
    for i in range(40):
        rows.append((i, " ".join(w)))
        for _ in range(3):
            w[rng.randrange(200)] = rng.choice(WORDS) + str(i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(198)} for i, t in rows}
    parts = groups(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, size=3, percent=85).collect()} == parts


def test_repeated_ids_lose_no_link(spark):
    a, b = text(80), text(80)
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (9, text(50)), (9, text(50)), (None, a)]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null").collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (9, 9), (9, 9)]


def test_pages_of_one_template(spark):
    """2,000 pages that share a template, at similarities around 0.8 and just below, some pairs of them above."""
    rng = random.Random(21)
    template, rows = [f"t{k}" for k in range(160)], []
    for i in range(2000):
        own = [f"{f'p{i}' if i % 40 else f'q{i // 80}'}w{k}" for k in range(rng.choice((18, 22, 30)))]
        rows.append((i, " ".join(template + own)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    inv = collections.defaultdict(list)
    for i, x in sets.items():
        inv[frozenset(x)].append(i)
    links, reps = [(v[0], i) for v in inv.values() for i in v[1:]], {v[0]: k for k, v in inv.items()}
    common = len(template) - 4
    for a, x in reps.items():
        for b, y in reps.items():
            if a < b and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and (a % 40 == b % 40 == 0 or 100 * common >= 80 * (len(x) + len(y) - common)) and 100 * len(x & y) >= 80 * len(x | y):
                links.append((a, b))
    want = groups(sets, links)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and 1 < len(set(want.values())) < 2000


def test_many_slots():
    x = np.random.default_rng(3).integers(0, 1 << 63, 30).astype(np.uint64)
    for slots in (100, 128, 420, 840):
        sig = minhash.superminhash(np.concatenate([x[:4], x]), np.array([0, 4, 34]), slots)
        assert (sig < 0xFFFFFFFF).all() and (sig >> minhash.level_bits(slots)).max() < slots


def test_superminhash_estimates():
    rng = np.random.default_rng(4)
    for n in (3, 40, 300, 3000):
        x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = np.sort(x[: int(1.5 * n)]), np.sort(x[int(0.5 * n) :])
        sig = minhash.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128)
        assert (sig < 0xFFFFFFFF).all() and abs((sig[0] == sig[1]).mean() - 0.5) < 0.17


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    want = groups({x for p in links for x in p}, links)
    assert all(want[x] == c for x, c in got.items()) and {x for a, b in links if a != b for x in (a, b)} == set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9


@pytest.mark.parametrize("span", [40, 400])
def test_repeated_passages(spark, docs, span, monkeypatch):
    texts = corpus()
    raws = {i: (t or "").encode() for i, t in texts}
    counts = collections.Counter(b[k : k + span] for b in raws.values() for k in range(len(b) - span + 1))
    want = {}
    for i, b in raws.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if counts[b[k : k + span]] > 1:
                gone[k : k + span] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated_passages(docs, span=span).collect()}
    assert got == want
    assert suffix_dedup.repeated_passages(docs.limit(0), span=span).count() == 0
    same = suffix_dedup.repeated_passages(docs.where("doc_id = 3").union(docs.where("doc_id = 3")), span=span, with_kept=False).collect()
    assert [r.n_removed for r in same] == [len(raws[3])] * 2


def test_long_texts_go_in_pieces():
    rng = np.random.default_rng(8)
    long_ = rng.integers(97, 123, 1_300_000).astype(np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array(["short" * 100, long_, None, "x"])], ["t"])
    seen = collections.Counter()
    for raw, starts, ends, rows, offsets in suffix_dedup._pieces(suffix_dedup._bytes(batch.column(0)), 400):
        assert len(raw) < 1 << 20
        _, _, lo, more, _ = suffix_dedup.runs(raw, starts, ends, 400)
        part = np.searchsorted(starts, lo, "right") - 1
        for k, at, m in zip(part, lo - starts[part], more):
            seen[rows[k]] += int(m) + 1
    assert seen == {0: 101, 1: 1_300_000 - 399}


def brute_shared(rows, span):
    """Documents (id, text) with `span` words in a row that another of them has."""
    holders = collections.defaultdict(set)
    for d in set(rows):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), d[1] or "").split()
        for k in range(len(w) - span + 1):
            holders[tuple(w[k : k + span])].add((d[0], d[1] or ""))
    return {d for x in holders.values() if len(x) > 1 for d in x}


@pytest.mark.parametrize("span, gram", [(50, 13), (12, 4)])
def test_shared_passages(spark, docs, span, gram):
    """Passages of just as many words and of one less, alone, in copies, repeated in one text, and chained."""
    rng = random.Random(31)
    passages = [text(n, rng) for n in (span - 1, span, span + 1, span + 9, 3 * span)]
    rows = corpus() + [(100 + i, f"{text(rng.randint(0, 90), rng)} {p} {text(rng.randint(0, 90), rng)}") for i, p in enumerate(passages * 2)]
    rows += [(200, f"{text(9, rng)} {(own := text(span + 20, rng))} {text(9, rng)} {own}"), (201, text(2 * span, rng)), (201, text(2 * span, rng)), (202, (x := text(80, rng))), (202, x), (None, text(70, rng)), (203, "w " * 400)]
    a, b = text(60, rng), text(60, rng)
    rows += [(300, f"{a} {b}"), (301, f"{a} {text(50, rng)}"), (302, f"{text(50, rng)} {b}"), (303, f"{text(30, rng)}\n{passages[1].upper()}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = [tuple(r) for r in suffix_dedup.shared_passages(df, span=span, gram=gram).collect()]
    want = brute_shared(rows, span)
    assert sorted(got, key=str) == sorted(((i, hashes[i, t]) for i, t in want), key=str) and len(want) > 20
    assert suffix_dedup.shared_passages(docs.limit(0)).count() == 0


def test_without_passages(spark, docs):
    """Both counts against plain loops: bytes anywhere, words in other documents, in copies, repeated in one text, chained, and with nothing left."""
    rng = random.Random(37)
    passages = [text(n, rng) for n in (11, 12, 13, 21, 36)]
    rows = corpus() + [(100 + i, f" {text(rng.randint(0, 40), rng)}\t {p} {text(rng.randint(0, 40), rng)}\n") for i, p in enumerate(passages * 2)]
    rows += [(200, f"{text(9, rng)} {(own := text(12, rng))} {text(9, rng)} {own}"), (201, (x := text(14, rng))), (201, x), (202, f" {passages[1]}\n"), (None, f"a {passages[2].upper()} b"), (203, "w " * 400)]
    a, b = text(15, rng), text(15, rng)
    rows += [(300, f"{a}\u00e9 {b}"), (301, f"{a} {text(9, rng)}"), (302, f"{text(9, rng)}  {b}"), (303, f"\u00e9{b}\u00e9"), (304, f"{text(30, rng)}\v{passages[3]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    span, word_span = 90, 12
    starts, holders, split = collections.Counter(), collections.defaultdict(set), {}
    for i, t in rows:
        raw = (t or "").encode()
        starts.update(raw[k : k + span] for k in range(len(raw) - span + 1))
        split[i, t or ""] = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(rb"[^ \t-\r]+", raw)]
    for d, w in split.items():
        for k in range(len(w) - word_span + 1):
            holders[tuple(x[2] for x in w[k : k + word_span])].add(d)
    want, by_words = {}, 0
    for d, w in split.items():
        raw = d[1].encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - span + 1):
            if starts[raw[k : k + span]] > 1:
                gone[k : k + span] = True
        n, met = gone.sum(), False
        for k in range(len(w) - word_span + 1):
            if len(holders[tuple(x[2] for x in w[k : k + word_span])]) > 1:
                gone[w[k][0] : w[k + word_span - 1][1]] = met = True
        if gone.any():
            left = bytes(x for x, g in zip(raw, gone) if not g)
            want[d] = b"" if met and not left.strip() else left
            by_words += gone.sum() > n
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = [(r.doc_id, r.text_hash, bytes(r.kept)) for r in suffix_dedup.without_passages(df, span=span, word_span=word_span, gram=4).collect()]
    assert sorted(got, key=str) == sorted(((d[0], hashes[d], x) for d, x in want.items()), key=str) and by_words > 10
    assert want[202, f" {passages[1]}\n"] == b""
    assert suffix_dedup.without_passages(docs.limit(0)).count() == 0


# --- 10


def test_vectors(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(60, 16))
    near = [b + rng.normal(size=16) * s for b in base[:20] for s in (0.05, 0.1, 0.3)]
    vecs = [*base, *near, base[0], base[0], 2 * base[1], -base[2], np.zeros(16)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2, "c") for i, v in enumerate(vecs)]
    rows += [(900, None, 0, "c"), (901, [1.0, None] + [0.0] * 14, 0, "c"), (902, [float("nan")] * 16, 0, "c"), (903, [float("inf")] * 16, 0, "c"), (904, rows[0][1], None, "c"), (905, [], 0, "c"), (906, [1.0, 0.0], 0, "c"), (907, [2.0, 0.0], 0, "c")]
    links = []
    fine = {i: np.array(v, float) for i, v, label, _ in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {r[0]: r[2] for r in rows}
    for a, x in fine.items():
        for b, y in fine.items():
            if a < b and label[a] == label[b] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((a, b))
    parts, n = groups([r[0] for r in rows], links), collections.Counter(x for p in links for x in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string").repartition(3)
    got = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert got == {i: (n[i], p, p == i) for i, p in parts.items()} and len(links) > 40
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(12)
    index = embedding_dedup.MultiIndex(embedding_dedup.unit(rng.normal(size=(500, 8))), 6, 0.93)
    for _ in range(20):
        a, b = rng.random(6), rng.random(6)
        cells = [a[i] + b[j] for i, j in index.walk(a, b)]
        want = sorted(x + y for x in a for y in b if x + y <= a.min() + b.min() + index.reach)
        assert np.allclose(cells, want)


def test_extreme_vectors_and_repeated_ids(spark):
    """One dimension, components whose squares over- or underflow, and rows that repeat an id."""
    rows = [(1, [3.0], 0), (2, [4.0], 0), (3, [-1.0], 0), (4, [1e200, 1.0], 0), (5, [1e200, 2.0], 0), (6, [1e-200, 0.0], 0), (7, [-2e-320, 0.0], 0), (8, [1.0, 0.0], 0), (9, [1e308, 1e308, -0.0], 0), (10, [1e-308, 1e-308, 0.0], 0)]
    rows += [(20, [0.0, 1.0, 0.0, 0.0], 1), (20, [1.0, 0.0, 0.0, 0.0], 1), (21, [0.99, 0.05, 0.0, 0.0], 1), (22, [0.0, 0.0, 0.0, 1.0], 1), (22, [0.0, 0.0, 0.0, 1.0], 1)]
    got = collections.Counter(map(tuple, embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 3, 4, True), (5, 3, 4, False), (6, 3, 4, False), (8, 3, 4, False), (7, 0, 7, True), (9, 1, 9, True), (10, 1, 9, False)]
    want += [(20, 0, 20, True), (20, 1, 20, True), (21, 1, 20, False), (22, 1, 22, True), (22, 1, 22, True)]
    assert got == collections.Counter(want)


def test_recall_on_a_fine_grid(spark, monkeypatch):
    """20,000 vectors of two labels on a grid of 22 x 22 cells; near copies in random and in few directions, many just at the threshold."""
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    rng = np.random.default_rng(17)
    n, dim = 16_000, 32
    base = embedding_dedup.unit(rng.normal(size=(n, dim)))
    away = rng.normal(size=(4000, dim))
    away[2000:, 3:] = 0
    away -= (away * base[:4000]).sum(1, keepdims=True) * base[:4000]
    c = rng.uniform(0.93, 0.96, (4000, 1))
    x = np.concatenate([base, c * base[:4000] + (1 - c**2) ** 0.5 * embedding_dedup.unit(away)])
    label = np.concatenate([np.arange(n) % 2, np.arange(4000) % 2])
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    want = np.zeros(len(x), int)
    for k in (0, 1):
        at = np.flatnonzero(label == k)
        for some in np.array_split(at, 10):
            want[some] = (x[some] @ x[at].T >= 0.93).sum(1) - 1
    got = np.array([r.n_links for r in sorted(embedding_dedup.near_duplicate_vectors(df).collect())])
    assert embedding_dedup.fitted(df.selectExpr("label", "size(embedding) dim", "xxhash64(embedding) hash", "embedding u"), 0.93, 20_000, 0.97)[dim].books[0].shape[0] >= 16
    print("recall", got.sum() / want.sum())
    assert (got <= want).all() and want.sum() > 7000 and got.sum() >= 0.95 * want.sum()


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(13)
    x = embedding_dedup.unit(np.ones(8) + rng.normal(size=(150, 8)) * 0.25)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = (x @ x.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert sum(abs(got[i] - w) for i, w in enumerate(want)) <= 0.02 * want.sum()
