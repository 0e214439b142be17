"""Reposts of one object, and pictures that several objects share."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.config import Config
from lotwise.functions import scalars as S
from lotwise.functions import text as X
from lotwise.operators.rules import dealer_any, dealer_strict, ensure_columns


def reposts(df: DataFrame, keys: tuple[str, ...] = ("title", "year", "price_tenge"), id_col: str = "ad_id", cfg: Config = Config()) -> DataFrame:
    """dup_reasons of rows that share title, year and price (nulls alike), unless a dealer's.

    A group of at most repost_group rows, all keys known, is strong if two of
    its rows have compatible colours and an equal mileage over the limit or an
    equal description.  Its rows are marked repost_corroborated; other shared
    rows only get the info flag same_title_year_price.
    """
    df = ensure_columns(df, {"color": "string", "condition": "string", "labels": "string", "info_flags": "string", "mileage_km": "double", "description": "string"})
    counts = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = df.join(counts, same, "left").drop(*[f"_k_{k}" for k in keys]).withColumns({"_n": F.coalesce("_n", F.lit(1)), "_dealer": dealer_strict(F.col("condition"), F.col("labels")), "_color": X.base_color(F.col("color"))})
    shared = F.col("_n") > 1
    few = rows.where(shared & (F.col("_n") <= cfg.repost_group) & ~F.col("_dealer")).dropna(subset=list(keys)).select(*keys, F.col(id_col).alias("_id"), "_color", F.col("mileage_km").alias("_km"), F.trim("description").alias("_text"))
    other = few.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("_id", "_color", "_km", "_text")])
    pairs = few.join(other, list(keys)).where("_id < _id2")
    color = (F.col("_color") == "") | (F.col("_color2") == "") | (F.col("_color") == F.col("_color2"))
    proof = ((F.col("_km") == F.col("_km2")) & (F.col("_km") > cfg.repost_mileage)) | ((F.col("_text") == F.col("_text2")) & (F.col("_text") != ""))
    strong = pairs.where(color & F.coalesce(proof, F.lit(False))).select(*keys).distinct().withColumn("_strong", F.lit(True))
    out = rows.join(strong, list(keys), "left")
    marked = shared & ~F.col("_dealer")
    weak = marked & F.col("_strong").isNull()
    info = F.array_union(F.array_remove(F.split(F.coalesce("info_flags", F.lit("")), "[|]"), ""), F.array(F.lit("same_title_year_price")))
    out = out.withColumns({"dup_reasons": F.when(marked & F.col("_strong"), "repost_corroborated").otherwise(""), "info_flags": F.when(weak, F.array_join(info, "|")).otherwise(F.coalesce("info_flags", F.lit("")))})
    return out.drop("_n", "_dealer", "_color", "_strong")


def same_hash_pairs(hashes: DataFrame, id_col: str = "ad_id", hash_col: str = "phash") -> DataFrame:
    """(ad_id_a, ad_id_b, hamming_distance 0) of objects that share a picture.

    Pairs of equal pictures of one object are made once: rows are distinct before the join.
    """
    rows = hashes.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("hash")).distinct()
    a, b = (rows.select(F.col("id").alias(f"ad_id_{s}"), "hash") for s in "ab")
    return a.join(b, "hash").where("ad_id_a < ad_id_b").select("ad_id_a", "ad_id_b", F.lit(0).alias("hamming_distance")).distinct()


def _bands(width: int, most: int, bands: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of parts of a hash: within `most` over all, some part lies within its radius.

    If every part were over its radius, the distance would be at least the sum
    of (radius + 1), which is most + 1.
    """
    bands = min(bands, most + 1, width)
    out, shift = [], 0
    for i in range(bands):
        bits = width // bands + (i < width % bands)
        out.append((shift, bits, (most + 1) // bands + (i < (most + 1) % bands) - 1))
        shift += bits
    return out


def near_hashes(distinct: DataFrame, most: int, width: int = 64, bands: int = 3, asked: DataFrame | None = None) -> DataFrame:
    """(bits_a, bits_b, d): pairs of distinct hashes within a Hamming distance, equal ones too, each once with bits_a <= bits_b.

    Hashes are cut into bands.  Two hashes within `most` are within a band's
    radius in at least one band, so each hash is dealt to its own value of each
    band and probes all values within the radius: an equi-join that loses
    nothing.  A pair that several bands meet is kept in the first.  With
    `asked` (bits), only pairs of these with any other are met, in both orders.
    Probes are many times the rows that Spark takes them for, so they are never broadcast.
    """
    parts = _bands(width, most, bands)
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    value = lambda shift, bits: F.shiftrightunsigned("bits", shift).bitwiseAND(signed((1 << bits) - 1))
    flips = [[sum(1 << at for at in places) for r in range(min(radius, bits) + 1) for places in combinations(range(bits), r)] for _, bits, radius in parts]
    own = F.array(*[F.struct(F.lit(i).alias("band"), value(shift, bits).alias("key")) for i, (shift, bits, _) in enumerate(parts)])
    probes = lambda i, shift, bits: F.transform(F.array(*map(signed, flips[i])), lambda x: F.struct(F.lit(i).alias("band"), value(shift, bits).bitwiseXOR(x).alias("key")))
    near = F.flatten(F.array(*[probes(i, shift, bits) for i, (shift, bits, _) in enumerate(parts)]))
    a = distinct.select(F.col("bits").alias("bits_a"), F.inline(own))
    b = (distinct if asked is None else asked).select(F.col("bits").alias("bits_b"), F.inline(near)).hint("merge")
    differ = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    first = F.coalesce(*[F.when(F.bit_count(differ.bitwiseAND(signed(((1 << bits) - 1) << shift))) <= radius, i) for i, (shift, bits, radius) in enumerate(parts)])
    d = S.hamming(F.col("bits_a"), F.col("bits_b")).cast("int")
    once = F.col("bits_a") <= F.col("bits_b") if asked is None else F.lit(True)
    return a.join(b, ["band", "key"]).where(once & (d <= most) & (F.col("band") == first)).select("bits_a", "bits_b", d.alias("d"))


def near_hash_pairs(hashes: DataFrame, most: int, id_col: str = "ad_id", bits_col: str = "bits", width: int = 64, bands: int = 3, asked: DataFrame | None = None) -> DataFrame:
    """All pairs of different objects within a Hamming distance, the smallest for each pair; with `asked`, those of its rows with any other.

    Distinct hashes are met first (see near_hashes); what is near is mapped back to the objects.
    """
    found = lambda df: df.where(F.col(bits_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(bits_col).cast("long").alias("bits")).distinct()
    rows = found(hashes)
    others = rows if asked is None else found(asked)
    met = near_hashes(rows.select("bits").distinct(), most, width, bands, None if asked is None else others.select("bits").distinct())
    sides = [df.select(F.col("id").alias(f"id_{s}"), F.col("bits").alias(f"bits_{s}")) for s, df in (("a", rows), ("b", others))]
    pairs = met.join(sides[0], "bits_a").join(sides[1], "bits_b")
    if asked is None:
        pairs = pairs.where((F.col("id_a") < F.col("id_b")) | ((F.col("id_a") > F.col("id_b")) & (F.col("bits_a") < F.col("bits_b"))))
    else:
        pairs = pairs.where("id_a <> id_b")
    return pairs.groupBy(F.least("id_a", "id_b").alias("ad_id_a"), F.greatest("id_a", "id_b").alias("ad_id_b")).agg(F.min("d").alias("hamming_distance"))


def different_objects(pairs: DataFrame, cars: DataFrame, id_col: str = "ad_id", cfg: Config = Config()) -> DataFrame:
    """Pairs whose two objects are known, not both dealers', and differ in model, year or price."""
    cars = ensure_columns(cars, {"condition": "string", "labels": "string"})
    side = lambda s: cars.select(F.col(id_col).alias(f"ad_id_{s}"), S.model_key(F.col("brand"), F.col("model")).alias(f"model_key_{s}"), F.col("price_tenge").alias(f"price_{s}"), F.col("year").alias(f"year_{s}"), dealer_any(F.col("condition"), F.col("labels")).alias(f"dealer_{s}"))
    out = pairs.join(side("a"), "ad_id_a").join(side("b"), "ad_id_b")
    price = F.abs(F.col("price_a") - F.col("price_b")) / F.nullif(F.greatest("price_a", "price_b"), F.lit(0)) > cfg.price_diff
    differ = (F.col("model_key_a") != F.col("model_key_b")) | F.coalesce(F.abs(F.col("year_a") - F.col("year_b")) >= cfg.year_diff, F.lit(False)) | F.coalesce(price, F.lit(False))
    names = ["ad_id_a", "ad_id_b", "hamming_distance", *[f"{c}_{s}" for s in "ab" for c in ("model_key", "price", "year")]]
    return out.where(~(F.col("dealer_a") & F.col("dealer_b")) & differ).select(*names)


def flag_pair_ends(df: DataFrame, pairs: DataFrame, id_col: str = "ad_id", reason: str = "photo_of_another_object") -> DataFrame:
    """photo_reasons of rows that are an end of a pair."""
    ends = pairs.select(F.col("ad_id_a").alias("_end")).union(pairs.select("ad_id_b")).distinct()
    return df.join(ends, F.col(id_col) == F.col("_end"), "left").withColumn("photo_reasons", F.when(F.col("_end").isNotNull(), reason).otherwise("")).drop("_end")


def gallery(photos: DataFrame, id_col: str = "ad_id") -> DataFrame:
    """urls: the pictures of each object in order of position; placeholders that are no address are left out."""
    rows = photos.where(F.startswith(F.col("url"), F.lit("http")))
    return rows.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda p: p["url"]).alias("urls"))


def numbered_photos(cards: DataFrame, id_col: str = "ad_id", urls_col: str = "urls") -> DataFrame:
    """(id, position from 1, url) in the order of first sight, each address once."""
    return cards.select(id_col, F.posexplode(F.array_distinct(urls_col)).alias("position", "url")).withColumn("position", F.col("position") + 1)
