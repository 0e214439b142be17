"""Odd rows of the summaries, and the estimate of single objects."""

import math

from pyspark.sql import functions as F

from lotwise.operators import pricing, summary


def test_progress_of_odd_and_empty_tables(spark):
    clean = spark.createDataFrame([(1, 1, "a", "", "archived"), (None, 1, None, "b", None), (2, None, "", None, None), (2, 0, None, None, "deleted")], "ad_id int, is_suspicious int, seller_comment string, description string, status string")
    enriched = spark.createDataFrame([(2, 200), (2, 404), (None, None)], "ad_id int, http_status int")
    photos = spark.createDataFrame([("http://a",), ("http://a",), ("http://b",), ("//none",), (None,)], "url string")
    hashes = spark.createDataFrame([("http://a", "f"), ("http://c", None), (None, "")], "url string, phash string")
    lifecycle = spark.createDataFrame([("archived", 9, None), (None, 9, None), ("active", 9, 1), ("active", 1, None)], "status string, seen_days int, checked_days int")
    journal = spark.createDataFrame([(1, "fraud", 1), (1, " LEGIT", 2), (2, None, 1), (3, "Fraud ", 1)], "ad_id int, verdict string, seq int")
    tables = [clean, enriched, photos, hashes, lifecycle, journal]
    got = {(r.section, r.counter): r.n for r in summary.progress(*tables).collect()}
    assert got == {
        ("pages", "total"): 4, ("pages", "suspicious"): 2, ("pages", "pending"): 2, ("pages", "pending_suspicious"): 2, ("pages", "read"): 1, ("pages", "failed"): 2,
        ("pictures", "placeholders"): 2, ("pictures", "done"): 2, ("pictures", "pending"): 1, ("pictures", "unreadable"): 2, ("texts", "full"): 1, ("texts", "stub"): 1, ("texts", "none"): 2,
        ("states", "archived"): 1, ("states", "active"): 2, ("states", "deleted"): 1, ("checks", "pending"): 1, ("verdicts", "fraud"): 1, ("verdicts", "legit"): 1, ("verdicts", "journal_rows"): 4, ("verdicts", "unknown"): 1,
    }
    empty = summary.progress(*[t.limit(0) for t in tables]).collect()
    assert len(empty) == 18 and {r.n for r in empty} == {0}


def test_selling_times_and_boxes(spark):
    df = spark.createDataFrame([(1, -1.0), (3, -0.5), (10, 0.0), (20, 2.0), (None, 1.0), (7, None)], "days int, residual double")
    got = summary.selling_times(df).first()
    assert (got.n, got.least, got.most, got.q50, got.n_below, got.n_above, got.median_below, got.median_above) == (5, 1, 20, 7.0, 2, 2, 2.0, 15.0)
    assert summary.selling_times(df.limit(0)).first().n == 0
    values = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [(None, 5.0), ("b", None)], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in summary.boxes(values, "v", "g").collect()}
    assert got == {"a": (5, 2.0, 3.0, 4.0, 1.0, 4.0, 1), None: (1, 5.0, 5.0, 5.0, 5.0, 5.0, 0)}


def test_hints(spark):
    df = spark.createDataFrame([(600.0, 1000.0), (599.0, 1000.0), (1e6, 0.0), (1e6, -1.0), (None, 5.0), (5.0, None), (1400.0, 1000.0)], "p double, m double")
    got = [r.h for r in df.select(summary.market_hint(F.col("p"), F.col("m")).alias("h")).collect()]
    assert got == ["<b>60% от средней цены</b> (1 000) — заметно ниже среднего", "<b>60% от средней цены</b> (1 000) — сильно дешевле рынка", "", "", "", "", "<b>140% от средней цены</b> (1 000) — существенно выше рынка — приманкой быть не может"]


def test_seeded_rows_do_not_depend_on_partitions(spark):
    ids = spark.range(500)
    pick = lambda df, seed: [r.id for r in summary.seeded_rows(df, 10, "id", seed).collect()]
    assert pick(ids.repartition(7), 3) == pick(ids.coalesce(1), 3) != pick(ids, 4)


def test_estimate_of_single_objects(spark):
    rows = [(float(a), b, math.log((30 - a) * (2.0 if b == "x" else 1.0) * 1e5)) for a in range(1, 21) for b in "xy"] * 3
    train = pricing.coerce_features(spark.createDataFrame(rows, "age double, brand string, log_price double")).fillna(0.0, [c for c in pricing.NUMERIC if c != "age"])
    model = pricing.price_pipeline(list(pricing.NUMERIC), list(pricing.CATEGORICAL), "log_price", max_depth=3, max_iter=10).fit(train)
    cars = spark.createDataFrame([("1", "x", 9), ("1", "y", 8), ("old", "never seen", 7)], "age string, brand string, log_price int")
    x, y, unknown = pricing.estimate(model, cars).collect()
    assert (x.age, x.brand, x.log_price) == ("1", "x", 9)
    assert abs(x.estimate / 5.8e6 - 1) < 0.25 and abs(y.estimate / 2.9e6 - 1) < 0.25 and unknown.estimate > 0
