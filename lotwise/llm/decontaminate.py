"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed to 64 bits.  Of the k-grams in each window of `span` words the
smallest hash is kept; as equal windows keep equal hashes, joining training and
test fingerprints meets every shared window, and comparing the words around a
hit settles it.  Arrays are exploded with the _outer functions: for the others
Spark adds a filter on the array's size, which repeats all the work below it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 13, 8

#: Test windows up to this number (about 200 bytes each) are broadcast; more are met by a shuffle.
BROADCAST_WINDOWS = 150_000


def hashed_words(text: Column) -> Column:
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _with_next(name: str, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with that `step` places on; `step` elements fewer."""
    there = F.slice(name, F.lit(1), F.greatest(F.size(name) - step, F.lit(0)))
    return F.transform(there, lambda x, i: join(x, F.get(name, i + step)))


def fingerprinted(df: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Adds fps to a frame with words: at i, the smallest hash of a k-gram in words i to i + span - 1."""

    def widen(df: DataFrame, column: str, length: int, join: Callable) -> DataFrame:
        done = 1
        while done < length:
            step = min(done, length - done)
            df = df.withColumn(column, _with_next(column, step, join))
            done += step
        return df

    df = widen(df.withColumn("fps", F.col("words")), "fps", gram, lambda a, b: F.xxhash64(a, b))
    return widen(df, "fps", span - gram + 1, F.least)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Words of documents that lie in a `span`-word passage of a test item.

    Returns a row for each id: n_words, n_hit (words inside shared passages),
    spans (array of start and end, not merged), items (array of item ids) and
    contaminated (n_hit > 0 and at least a twentieth of the words).  An item of
    fewer than `span` words is one window; one without words is none.  An item
    without an id counts like any other, and all of them give one null among
    items.  Null or empty texts have no words and no hits.  Rows that repeat an id count as one
    document (null ids too).  Very long texts are read whole; an empty table gives
    no rows, an empty benchmark no hits.  Only ids and texts are read; other
    columns may have any name.  Words are compared as 64-bit hashes, all `span`
    of a window.
    """
    words = docs.select(F.col(id_col).alias("id"), hashed_words(F.col(text_col)).alias("words"))
    items = benchmark.select(F.col(item_col).alias("item"), hashed_words(F.col(item_text_col)).alias("words"))
    long_items = fingerprinted(items.where(F.size("words") >= span), span, gram).select("item", "words", F.posexplode_outer("fps").alias("at", "fp"))
    tests = long_items.select("fp", F.slice("words", F.col("at") + 1, span).alias("win"), "item").distinct().withColumn("met", F.lit(True))
    shorts = items.where((F.size("words") > 0) & (F.size("words") < span)).distinct()
    n_windows, n_shorts = tests.count(), shorts.count()
    small = n_windows <= broadcast_windows

    rows = fingerprinted(words, span, gram)
    if not small:
        shared = rows.select("id", F.explode_outer(F.array_distinct("fps")).alias("fp")).join(tests.select("fp").distinct(), "fp", "left_semi")
        shared = shared.groupBy(F.col("id").alias("of")).agg(F.collect_set("fp").alias("shared"))
        rows = rows.join(shared, F.col("id").eqNullSafe(F.col("of")), "left")
    rows = rows.select("id", "words", *([] if small else ["shared"]), F.posexplode_outer("fps").alias("at", "fp"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    if not small:
        rows = rows.where(first | F.array_contains("shared", F.col("fp")))
    rows = rows.withColumn("n_words", F.size("words"))
    here = F.slice("words", F.col("at") + 1, span)
    if small:
        met = rows.join(F.broadcast(tests.withColumnRenamed("fp", "test_fp")), (F.col("fp") == F.col("test_fp")) & (here == F.col("win")), "left")
    else:
        met = rows.select("id", "n_words", "at", "fp", here.alias("win")).join(tests, ["fp", "win"], "left")
    met = met.where(first | F.col("met"))
    hits = met.select("id", "n_words", F.when(F.col("met"), F.struct(F.col("at").alias("start"), (F.col("at") + span).alias("end"))).alias("hit"), F.when(F.col("met"), F.struct("item")).alias("of"))
    if n_shorts:
        hits = hits.unionByName(_short_hits(words, shorts, span, n_shorts <= broadcast_windows))
    found = hits.groupBy("id").agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set("hit").alias("spans"), F.transform(F.collect_set("of"), lambda x: x["item"]).alias("items"))
    n_hit = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    out = found.withColumn("n_hit", n_hit)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _short_hits(words: DataFrame, shorts: DataFrame, span: int, small: bool) -> DataFrame:
    """Places of items shorter than a window: met at their word of the smallest hash, then compared whole.

    Beyond what is broadcast, a place travels with no more words than the
    longest item that has this word could need, not with its document.
    """
    tests = shorts.select("item", F.col("words").alias("win"), F.array_min("words").alias("fp")).withColumn("off", F.array_position("win", F.col("fp")).cast("int") - 1)
    rows = words.select("id", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("at", "word"))
    if small:
        start = F.col("at") - F.col("off")
        here = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("win"))
        met = rows.join(F.broadcast(tests), (F.col("word") == F.col("fp")) & (start >= 0) & (here == F.col("win")))
    else:
        from_ = F.greatest(F.col("at") - span + 2, F.lit(0))
        rows = rows.select("id", "n_words", "at", "word", from_.alias("from"), F.slice("words", from_ + 1, 2 * span - 3).alias("near"))
        start = F.col("at") - F.col("off")
        here = F.slice("near", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.size("win"))
        met = rows.join(tests, (F.col("word") == F.col("fp")) & (start >= 0) & (here == F.col("win")))
    return met.select("id", "n_words", F.struct(start.alias("start"), (start + F.size("win")).alias("end")).alias("hit"), F.struct("item").alias("of"))
