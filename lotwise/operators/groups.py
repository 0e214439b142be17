"""Groups of objects whose picture hashes are equal or near, with a row for each picture and no pairs in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators import duplicates
from lotwise.sources import working


def _starred(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node's larger (or other) neighbours linked to the least of its neighbours and itself."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(turned) if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = near.join(least, "u")
    if larger:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(u, v): each node of a frame of links (u, v) but the least of its component, and that least node.

    Large and small stars alternate until only stars are left; each round is
    written, and the number of rounds grows with the logarithm of the nodes.
    """
    edges = working.written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        done = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty() and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
        if done:
            return edges
        edges = working.written(_starred(working.written(_starred(edges, larger=True)), larger=False))


def hash_groups(hashes: DataFrame, most: int, id_col: str = "ad_id", bits_col: str = "bits", width: int = 64, bands: int = 3) -> DataFrame:
    """(id, bits, representative, group_id, n_links) of each distinct picture hash of an object.

    Two pictures are linked if their hashes differ in at most `most` bits, those
    of one object too.  representative is the smallest id with an equal hash,
    group_id the smallest id that links reach, n_links the number of other
    pictures linked directly.  Equal hashes are one class, counted before they
    are met, so a hot one costs one row; only links between classes are made.
    Rows without a hash are groups of their own, rows without an id are left out.
    """
    rows = hashes.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(bits_col).cast("long").alias("bits")).distinct()
    classes = working.written(rows.where("bits is not null").groupBy("bits").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("size")))
    links = working.written(duplicates.near_hashes(classes.select("bits"), most, width, bands).where("bits_a < bits_b").select("bits_a", "bits_b"))
    both = links.unionByName(links.select(F.col("bits_b").alias("bits_a"), F.col("bits_a").alias("bits_b")))
    degrees = both.join(classes.select(F.col("bits").alias("bits_b"), "size"), "bits_b").groupBy("bits_a").agg(F.sum("size").alias("others"))
    stars = connected(links.select(F.col("bits_a").alias("u"), F.col("bits_b").alias("v")))
    of = classes.join(degrees, F.col("bits") == F.col("bits_a"), "left").join(stars, F.col("bits") == F.col("u"), "left").select("bits", "representative", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("v", "bits").alias("root"))
    of = working.written(of)
    least = of.groupBy("root").agg(F.min("representative").alias("group_id"))
    of = of.join(least, "root").select(F.col("bits").alias("_bits"), "representative", "group_id", "n_links")
    out = rows.join(of, F.col("bits") == F.col("_bits"), "left")
    return out.select(F.col("id").alias(id_col), F.col("bits").alias(bits_col), F.coalesce("representative", "id").alias("representative"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def nearest_pairs(hashes: DataFrame, most: int, queries: DataFrame, n: int, id_col: str = "ad_id", bits_col: str = "bits", width: int = 64, bands: int = 3) -> DataFrame:
    """The n pairs of smallest distance of pictures that `queries` asks for, against all: (ad_id_a, ad_id_b, hamming_distance), nearest first, then by ids."""
    asked = queries.select(F.col(id_col).alias("_q")).distinct()
    wanted = hashes.join(asked, F.col(id_col) == F.col("_q"), "left_semi")
    return duplicates.near_hash_pairs(hashes, most, id_col, bits_col, width, bands, wanted).orderBy("hamming_distance", "ad_id_a", "ad_id_b").limit(n)
