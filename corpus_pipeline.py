"""From raw documents to token ids: quality, near-duplicates, repeated passages, contamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, decontaminate, minhash, quality, scratch, suffix_dedup

TOKENIZER = "word_bpe_49k.json"
LEAST_QUALITY = 0.7


def joined(docs: DataFrame, found: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on equal keys, nulls alike, after which columns of `docs` keep their names whatever they are."""
    own = {k: f"{k}_{uuid.uuid4().hex}" for k in keys}
    same = functools.reduce(Column.__and__, [docs[k].eqNullSafe(F.col(own[k])) for k in keys])
    return docs.join(found.withColumnsRenamed(own), same, how).drop(*own.values())


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labels of three of four folds of ids.

    Each row is judged by its own text, whole however long; null and empty texts
    get a score too, repeated rows the same one.  Rows without an id are judged
    but never learned from.  Without labels the scores are those of an untrained
    model; no rows in, no rows out; extra columns may have any name.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, least=LEAST_QUALITY)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id; sets of five-word shingles at 80 of 100.

    Decided row by row, by id and text: another text of a kept id goes if its
    own group has a smaller id.  Rows equal in both stay or go together.  Null,
    empty and wordless texts and rows without an id are kept; very long texts
    are sets like any others; no rows in, no rows out; extra columns may have any name.
    """
    kept = minhash.near_duplicates(docs, size=5, percent=80, with_key=True).where("kept").select("row_key").distinct()
    key = f"row_key_{uuid.uuid4().hex}"
    rows = docs.withColumn(key, minhash.row_key(F.col("doc_id"), F.col("text")))
    return joined(rows, kept.withColumnRenamed("row_key", key), [key], "left_semi").drop(key)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur again; a document of which nothing is left goes.

    A passage is of 400 bytes that start anywhere else too, or of 50 words that
    another document has too, A-Z in lower case, however few bytes these are.
    A character cut by the end of a passage becomes U+FFFD.  Null and empty
    texts have no passage and stay; very long texts are read whole; a passage
    that rows of one id share, or equal rows, goes from all of them, so of equal
    rows of 400 bytes or more none is left (shorter equal rows are one document);
    no rows in, no rows out; extra columns may have any name.
    """
    found = suffix_dedup.without_passages(docs)
    changed = found.select("doc_id", "text_hash", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept"))
    kept = f"kept_{uuid.uuid4().hex}"
    hashed = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias(f"text_hash_{kept}"))
    rows = joined(hashed, changed.withColumnsRenamed({"text_hash": f"text_hash_{kept}", "kept": kept}), ["doc_id", f"text_hash_{kept}"], "left")
    text = {"text": F.coalesce(kept, "text"), "n_chars": F.when(F.col(kept).isNotNull(), F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return rows.where(F.col(kept).isNull() | (F.col(kept) != "")).withColumns(text).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is shared with test items.

    Decided by text alone, so rows that repeat an id, or have none, do not
    answer for each other; equal texts are judged once.  Null and empty texts
    have no words and stay; very long texts are read whole; no rows in, no rows
    out; without test items all stay; extra columns may have any name.
    """
    key = f"text_hash_{uuid.uuid4().hex}"
    rows = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).where("contaminated").select(key)
    return joined(rows, found, [key], "left_anti").drop(key)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row, repeated ones too.

    Null and empty texts have no ids, very long ones all of theirs; no rows in,
    no rows out; extra columns are not read.
    """
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near-duplicates", one_of_near_duplicates),
    ("repeated passages", without_repeated_passages),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
