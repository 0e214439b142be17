"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import alignment, bpe, decontaminate, embedding_dedup, fill_middle, minhash, quality, scratch, suffix_dedup, token_counts, token_files, toxicity, url_filter, warc

TOKENIZER, VOCABULARY, END_ID = "word_bpe_49k.json", 49_408, 1
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), url_filter.rules_frame(spark, url_filter.DEFAULT_RULES))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("passages")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), VOCABULARY, END_ID)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(read(spark, sf_dir, "pages"), scratch.folder(spark, "warc"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a column more: whether the document shares 50 words in a row with another, be they 400 bytes or not."""
    docs = read(spark, sf_dir, "documents")
    shared = suffix_dedup.shared_passages(docs).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), F.lit(True).alias("shares_passage"))
    found = suffix_dedup.repeated_passages(docs, with_kept=False)
    found = found.join(shared, (F.col("text_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_bpe, op3_quality, op4_toxicity, op5_decontamination, op6_token_files, op7_warc, op8_near_duplicates, op9_repeated_passages, op10_embeddings, op11_alignment, op12_fill_in_middle, op13_token_counts)}

ORACLE_SQL = {
    "op1_url_filters": r"""
        WITH rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
        parts AS (
            SELECT page_id,
                coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM rest),
        rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
            FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
    "op5_decontamination": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(len(w), 13) AS m FROM items WHERE len(w) > 0),
        wins AS (
            SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
            FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
        places AS (
            SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m)),
        hits AS (SELECT doc_id, i, m, item_id FROM places JOIN wins USING (m, win)),
        counted AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM words LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_warc": r"""
        WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        bits AS (
            SELECT page_id, body, strlen(body) AS n, min(page_id) OVER (PARTITION BY body) AS first_id,
                array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(CAST('0x' || substr(sha1(body), i, 1) AS BIGINT)), 4)), '') AS b
            FROM bodies)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda k: CAST(substr(b, 5 * i + k, 1) AS INTEGER) * (1 << (5 - k)))) AS INTEGER), 1)), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM bits""",
    "op8_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, md5_number(array_to_string(list_slice(w, i, i + 2), ' ')) AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        meets AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT x, y FROM meets JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
        SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept
        FROM reach JOIN documents ON doc_id = x LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op10_embeddings": r"""
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (
            SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        degree AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x),
        reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
        SELECT vec_id, coalesce(max(n), 0) AS n_links, min(y) AS component_id, vec_id = min(y) AS kept
        FROM reach JOIN embeddings ON vec_id = x LEFT JOIN degree USING (vec_id) GROUP BY vec_id""",
}
