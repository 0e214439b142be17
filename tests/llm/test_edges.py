"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from lotwise.llm import alignment, bpe, decontaminate, embedding_dedup, fill_middle, minhash, quality, suffix_dedup, token_counts, token_files, toxicity, url_filter, warc

TOKENIZER, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "so few words here but very many of them all. " * 6000

#: Names that operators use for columns of their own.
CLASHES = ["id", "h", "label", "labelled", "own", "of", "n", "size", "score", "quality_score", "kept", "kept_id", "changed_id", "text_hash", "bad_id", "words", "fps", "at", "fp", "item", "node", "component", "rep", "part", "u", "v", "digest", "first"]

ROWS = [(None, None), (None, "no id at all"), (1, ""), (2, "one two"), (2, "one two"), (3, LONG), (4, LONG), (5, " \t\n "), (6, "A b c d e f g h i j k l m n"), (6, "another text of the same id")]


@pytest.fixture(scope="module")
def clashing(spark):
    """(frame of documents with extra columns, number of rows)."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(CLASHES)) for i, t in ROWS], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2, "x", "y") for i in range(1, 7)] + [(1, 1, 1, "x", "y"), (None, 1, 1, "x", "y"), (2, None, None, "x", "y")], "doc_id long, quality int, toxic int, label string, labelled string")


def benchmark(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j k l m", "x"), (None, "one two", "x"), (3, None, "x")], "item_id long, text string, words string")


OPERATORS = {
    "bpe": lambda s, d, l: bpe.encode_documents(d, TOKENIZER),
    "quality": lambda s, d, l: quality.quality(d, l),
    "toxicity": lambda s, d, l: toxicity.toxicity(d, l),
    "decontamination": lambda s, d, l: decontaminate.decontaminate(d, benchmark(s)),
    "token files": lambda s, d, l: token_files.round_trip(d, TOKENIZER, 49_408, 1),
    "near-duplicates": lambda s, d, l: minhash.near_duplicates(d),
    "passages": lambda s, d, l: suffix_dedup.repeated_passages(d),
    "shared passages": lambda s, d, l: suffix_dedup.shared_passages(d),
    "url": lambda s, d, l: url_filter.filter_urls(d, url_filter.rules_frame(s, url_filter.DEFAULT_RULES), "doc_id", "text"),
    "warc": lambda s, d, l: warc.read(warc.write(d, corpus_pipeline.scratch.folder(s, "edges"), "doc_id", "text", "text"), "doc_id"),
    "alignment": lambda s, d, l: alignment.link_statistics(d, BYTES, PIECES),
    "aligned texts": lambda s, d, l: alignment.align(d, BYTES, PIECES),
    "fill-in-middle": lambda s, d, l: fill_middle.fill_in_middle(d),
    "token counts": lambda s, d, l: token_counts.count_tokens(d, PIECES),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, clashing, labels, name):
    got = OPERATORS[name](spark, clashing, labels).collect()
    want = {"decontamination": 7, "shared passages": 2}.get(name, len(ROWS))  # one row for each id; only the long texts share a passage
    assert len(got) == want
    by_id = {r.doc_id: r for r in got}
    if name == "bpe":
        assert by_id[1].n_tokens == by_id[5].n_tokens == 0 and by_id[3].n_tokens == by_id[4].n_tokens > 50_000
    if name in ("quality", "toxicity"):
        assert by_id[3].score == by_id[4].score and not by_id[None].held_out and all(0 <= r.score <= 1 for r in got)
    if name == "decontamination":
        assert by_id[6].contaminated and by_id[2].n_hit == 2 and by_id[2]["items"] == [None] and not by_id[3].contaminated
    if name == "token files":
        assert sorted(r.start for r in got)[0] == 0 and by_id[1].n_tokens == 1 and by_id[3].ids_crc32 == by_id[4].ids_crc32
    if name == "near-duplicates":
        assert by_id[4].component_id == 3 and sum(r.kept for r in got if r.doc_id == 2) == 2
    if name == "passages":
        assert by_id[3].n_removed == by_id[3].n_bytes == len(LONG) and by_id[1].n_bytes == 0
    if name == "warc":
        assert by_id[4].record_type == "revisit" and by_id[4].refers_to == 3
    if name == "alignment":
        assert by_id[1].n_a == 0 and by_id[1].groups_sha256 == "" and by_id[3].count_sum == by_id[4].count_sum > by_id[3].n_links
    if name == "fill-in-middle":
        assert by_id[1].form == "plain" and by_id[3].restored_sha256 == by_id[4].restored_sha256 and by_id[3].n == len(LONG)
    if name == "token counts":
        assert by_id[1].n_tokens == 0 and by_id[3].over_limit and by_id[3].n_bytes == len(LONG)
    assert OPERATORS[name](spark, clashing.limit(0), labels).count() == 0


def test_odd_labels(spark, clashing, labels):
    """No labels at all, and labels of one kind."""
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert quality.quality(clashing, some).count() == toxicity.toxicity(clashing, some).count() == len(ROWS)


def test_odd_vectors(spark):
    rows = [(None, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [1.0, 0.0], None), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [1.0] * 5000, 1), (6, [1.0] * 5000, 1)]
    df = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], "vec_id long, embedding array<double>, label int, u string, node string, id string, hash string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    assert got == [(0, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 5, True), (6, 1, 5, False)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_clashing_names(spark, clashing, labels, tmp_path, name):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, clashing, str(tmp_path))
    assert out.count() <= len(ROWS)
    if name != "encoding":
        assert out.columns == clashing.columns and all(r[c] == "x" for r in out.collect() for c in CLASHES)
