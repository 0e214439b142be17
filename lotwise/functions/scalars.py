"""Numbers, dates and hashes of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: first letters of the months
MONTHS = {"янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "мая": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12}


def round_even(c: Column, digits: int = 2) -> Column:
    return F.rint(c * 10**digits) / 10**digits


def age(year: Column, as_of_year: int) -> Column:
    return F.lit(as_of_year) - year + 1


def age_bucket(c: Column) -> Column:
    """(0, 3], (3, 7], (7, 12], (12, 20] and over; null at 0 or less."""
    return F.when(c <= 0, None).when(c <= 3, "0-3").when(c <= 7, "4-7").when(c <= 12, "8-12").when(c <= 20, "13-20").when(c > 20, "20+")


def price_segment(c: Column, cuts: tuple[float, ...] = (5e6, 10e6, 20e6)) -> Column:
    out = F.when(c <= 0, None)
    for i, cut in enumerate(cuts):
        out = out.when(c <= cut, f"s{i + 1}")
    return out.when(c > cuts[-1], f"s{len(cuts) + 1}")


def price_band(ratio: Column) -> Column:
    """Price over the market's: a boundary belongs to the band above it."""
    return F.when(ratio < 0.60, "far below").when(ratio < 0.85, "below").when(ratio < 1.15, "market").when(ratio < 1.40, "above").when(ratio.isNotNull(), "far above")


def risk_zone(requests: Column) -> Column:
    return F.when(requests <= 100, "green").when(requests <= 200, "yellow").when(requests <= 270, "orange").when(requests > 270, "red")


def next_action(gap_before: Column, gap_after: Column, failed: Column, limited: Column) -> Column:
    """What a drain does after a chunk; the first that holds."""
    return F.when(gap_after <= 0, "done").when(limited, "rate_limited").when(failed, "breaker").when(gap_after >= gap_before, "stuck").otherwise("continue")


def within_budget(used: Column, spent: Column, gap: Column, chunk: Column, cap: Column, run_cap: Column) -> Column:
    step = F.least(chunk, gap)
    return (used + step <= cap) & (spent + step <= run_cap)


def model_key(brand: Column, model: Column) -> Column:
    return F.trim(F.concat(F.coalesce(brand, F.lit("")), F.lit(" "), F.coalesce(model, F.lit(""))))


def is_junk_mileage(c: Column) -> Column:
    """One digit five times or more, and over 300,000."""
    return F.coalesce(c.cast("bigint").cast("string").rlike(r"^(\d)\1{4,}$") & (c > 300_000), F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_of_hex(c: Column) -> Column:
    """16 hexadecimal digits as a signed 64-bit integer."""
    return F.conv(c, 16, -10).cast("bigint")


def posted_date(c: Column, as_of_year: int) -> Column:
    """'18 июля' or '18 июл.' in that year; null for anything else."""
    low = F.lower(c)
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(months, F.substring(F.regexp_extract(low, r"(?U)^\s*\d{1,2}\s+([а-яё]+)", 1), 1, 3))
    day = F.regexp_extract(low, r"(?U)^\s*(\d{1,2})\s+[а-яё]+", 1)
    return F.try_to_date(F.concat_ws("-", F.lit(as_of_year), month, F.when(month.isNotNull() & (day != ""), day)), "y-M-d")


def iso_date(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def duplicate_group(ad_id: Column, facts: list[Column], text: Column, least: int = 15) -> Column:
    """A hash that listings of one object share: its facts and its text, or its id where the text says too little."""
    from lotwise.functions.text import squeeze

    plain = squeeze(F.lower(F.coalesce(text, F.lit(""))))
    own = F.when(F.length(plain) >= least, plain).otherwise(F.concat(F.lit("ad:"), ad_id.cast("string")))
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(f.cast("string"), F.lit("")) for f in facts], own), 256)


def mean_pause(low: Column, high: Column, long_low: Column, long_high: Column, every: Column) -> Column:
    """Mean seconds of a pause when each `every`-th one is a long one."""
    return (low + high) / 2 + (long_low + long_high) / 2 / every


def eta_minutes(gap: Column, pause: Column) -> Column:
    return F.ceil(gap * pause / 60)


def timestamp_of(c: Column) -> Column:
    """A timestamp from text; null where it is none."""
    return F.try_to_timestamp(c.cast("string"))
