"""Summaries: how far each job has come, selling times, boxes, the market's hint, rows for a spotlight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.config import Config
from lotwise.functions import scalars as S
from lotwise.functions import text as X
from lotwise.operators import quantiles, status, upserts

# fixed values: what is said of a price over the market's, for each band of scalars.price_band
BAND_WORDS = {"far below": "сильно дешевле рынка", "below": "заметно ниже среднего", "market": "в пределах среднего", "above": "выше среднего", "far above": "существенно выше рынка — приманкой быть не может"}


def counters(df: DataFrame, section: str, **counts: Column) -> DataFrame:
    """(section, counter, n): one aggregation of the table, a row for each count; 0 for an empty table."""
    one = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in counts.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("counter"), F.col(name).alias("n")) for name in counts])
    return one.select(F.lit(section).alias("section"), F.inline(rows))


def progress(clean: DataFrame, enriched: DataFrame, photos: DataFrame, hashes: DataFrame, lifecycle: DataFrame, journal: DataFrame, cfg: Config = Config(), id_col: str = "ad_id", seq: str = "seq") -> DataFrame:
    """(section, counter, n) of pages, pictures, texts, states, checks and verdicts.

    `clean` has is_suspicious, seller_comment, description and status;
    `enriched` http_status; `photos` and `hashes` url, the latter phash;
    `lifecycle` a row for each object with status, seen_days and checked_days;
    `journal` verdict.  A row of `clean` whose id is null is never looked up,
    so it stays pending.  Pictures without an address are placeholders and are
    left out of the rest; a repeated one counts each time.  A null state is
    active.  Of an object's verdicts the last one counts, in lower case.
    """
    done = enriched.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_done")).distinct()
    pending = F.col("_done").isNull()
    suspicious = F.coalesce(F.col("is_suspicious").cast("int"), F.lit(0)) == 1
    full, stub = (F.length(F.coalesce(c, F.lit(""))) > 0 for c in ("seller_comment", "description"))
    hashed = hashes.where(F.col("url").isNotNull()).select(F.col("url").alias("_hashed")).distinct()
    address = F.startswith(F.coalesce("url", F.lit("")), F.lit("http"))
    verdict = F.lower(F.trim("verdict"))
    known = F.coalesce(verdict.isin("fraud", "legit"), F.lit(False))
    parts = [
        counters(clean.select(id_col, "is_suspicious").join(done, F.col(id_col) == F.col("_done"), "left"), "pages", total=F.count(F.lit(1)), suspicious=F.count_if(suspicious), pending=F.count_if(pending), pending_suspicious=F.count_if(pending & suspicious)),
        counters(enriched, "pages", read=F.count_if(F.col("http_status") == 200), failed=F.count_if(~F.coalesce(F.col("http_status") == 200, F.lit(False)))),
        counters(photos.select("url").join(hashed, F.col("url") == F.col("_hashed"), "left"), "pictures", placeholders=F.count_if(~address), done=F.count_if(address & F.col("_hashed").isNotNull()), pending=F.count_if(address & F.col("_hashed").isNull())),
        counters(hashes, "pictures", unreadable=F.count_if(F.coalesce("phash", F.lit("")) == "")),
        counters(clean, "texts", full=F.count_if(full), stub=F.count_if(~full & stub), none=F.count_if(~full & ~stub)),
        clean.groupBy(F.lit("states").alias("section"), F.coalesce("status", F.lit("active")).alias("counter")).agg(F.count(F.lit(1)).alias("n")),
        counters(lifecycle, "checks", pending=F.count_if(status.needs_check(F.col("status"), F.col("seen_days"), F.col("checked_days"), cfg))),
        counters(upserts.keep_last(journal.select(id_col, verdict.alias("verdict"), seq), [id_col], seq), "verdicts", fraud=F.count_if(F.col("verdict") == "fraud"), legit=F.count_if(F.col("verdict") == "legit")),
        counters(journal, "verdicts", journal_rows=F.count(F.lit(1)), unknown=F.count_if(~known)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def selling_times(df: DataFrame, days: str = "days", residual: str = "residual") -> DataFrame:
    """One row: the distribution of days, its correlation with the residual, and medians below and at or above a fair price.

    Rows without days are left out, those without a residual of the split and
    the correlation.  Percentiles count distinct days, so their state is small.
    """
    d, below = F.col(days), F.col(residual) < 0
    at = {f"q{p}": F.percentile(d, F.lit(p / 100)) for p in (25, 50, 75)}
    split = {"n_below": F.count_if(below), "n_above": F.count_if(~below), "median_below": F.median(F.when(below, d)), "median_above": F.median(F.when(~below, d))}
    stats = {"n": F.count(F.lit(1)), "mean": F.avg(d), "std": F.stddev(d), "least": F.min(d), "most": F.max(d)} | at | split | {"corr": F.corr(d.cast("double"), residual)}
    return df.where(d.isNotNull()).agg(*[c.alias(name) for name, c in stats.items()])


def boxes(df: DataFrame, value: str, group: str, cfg: Config = Config()) -> DataFrame:
    """(group, n, q1, median, q3, whisker_low, whisker_high, n_outside) of the values of each group, null ones a group too.

    Whiskers end at the last values within the fences.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if quantiles.is_large(df):
        q = None
        for name, share in shares.items():
            one = quantiles.group_quantile(known, ["_g"], "_v", share, large=True).select(F.col("_g").alias("_of" if q is None else "_again"), F.col("q").alias(name))
            q = one if q is None else q.join(one, F.col("_of").eqNullSafe(F.col("_again"))).drop("_again")
    else:
        q = known.groupBy(F.col("_g").alias("_of")).agg(*[F.percentile("_v", F.lit(share)).alias(name) for name, share in shares.items()])
    step = cfg.iqr_multiplier * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - step, F.col("q3") + step)
    rows = known.join(q, F.col("_g").eqNullSafe(F.col("_of"))).groupBy(F.col("_g").alias(group), *shares)
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"), F.count_if(~inside).alias("n_outside"))
    return out.select(group, "n", *shares, "whisker_low", "whisker_high", "n_outside")


def market_hint(price: Column, market: Column) -> Column:
    """The share of the market's price in words; empty unless both are known and the market's is over 0."""
    ratio = price.cast("double") / F.nullif(market.cast("double"), F.lit(0.0))
    words = F.lit(None).cast("string")
    for band, said in BAND_WORDS.items():
        words = F.coalesce(words, F.when(S.price_band(ratio) == band, said))
    hint = F.concat(F.lit("<b>"), F.rint(ratio * 100).cast("bigint").cast("string"), F.lit("% от средней цены</b> ("), X.money(market), F.lit(") — "), words)
    return F.when((market > 0) & price.isNotNull(), hint).otherwise("")


def with_suspicion(queue: DataFrame, clean: DataFrame, id_col: str = "ad_id") -> DataFrame:
    """is_suspicious of each queued row, 0 where the clean layer does not know it; of rows with one id any suspicious one counts."""
    flags = clean.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("is_suspicious").cast("int")).alias("_flag"))
    out = queue.join(flags, F.col(id_col) == F.col("_id"), "left")
    return out.withColumn("is_suspicious", F.coalesce("_flag", F.lit(0))).drop("_id", "_flag")


def seeded_rows(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """n rows that a seed picks, the same however the table is partitioned; the ids are the order of ties."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)
