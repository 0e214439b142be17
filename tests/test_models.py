"""Boosted trees and target statistics against plain numpy on small tables, and their worth on planted prices."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import boosting, encoding, evaluation, pricing, quantiles

FEATURES = ["age", "km", "brand_stat", "model_stat"]


@pytest.fixture(scope="module")
def cars(spark):
    rng, rows = random.Random(1), []
    for i in range(1500):
        brand = rng.choice("AAABCD")
        model, age, km = f"{brand}{rng.randrange(4)}", rng.choice([None, *range(20)]), rng.randrange(0, 300_000)
        spread = 0.05 + 0.03 * (age or 0)
        price = 10 + 0.4 * (ord(brand) - 64) + 0.1 * int(model[1]) - 0.08 * (age or 10) - km / 1e6 + rng.gauss(0, spread)
        rows.append((i, brand, model, age, float(km), price))
    df = spark.createDataFrame(rows, "id long, brand string, model_name string, age int, km double, y double")
    return pricing.with_fold(df.withColumnRenamed("model_name", "model_key"), F.concat_ws("#", "model_key", "age"), 3).cache()


def encoded(df, folds=3):
    df = df.withColumnRenamed("model_key", "car")
    out = encoding.for_each_fold(df, ["brand", "car"], "y", "id", folds)
    return out.withColumnRenamed("car_stat", "model_stat")


# --- ordered target statistics


def perm(i, seed=0):
    return hashlib.md5(f"{seed}#{i}".encode()).hexdigest()


@pytest.mark.parametrize("blocks", [1, 7, 256])
def test_ordered_statistics(spark, blocks):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(80)]), rng.choice(["a", "a", "b", None]), rng.choice([None, rng.random()]), rng.random() < 0.2) for _ in range(200)]
    got = encoding.ordered_statistics(spark.createDataFrame(rows, "id long, c string, y double, late boolean").repartition(3), "c", "y", "id", "x", last=F.col("late"), weight=2.0, blocks=blocks).collect()
    learned = [r for r in rows if not r[3]]
    known = [y for _, _, y, _ in learned if y is not None]
    prior = sum(known) / len(known)
    text = lambda i: hashlib.md5(("0" if i is None else f"0#{i}").encode()).hexdigest()

    def want(i, c, late):
        earlier = [y for j, d, y, _ in learned if d == c and y is not None and (late or text(j) < text(i))]
        return (sum(earlier) + 2 * prior) / (len(earlier) + 2)

    assert sorted((str(r.id), str(r.c), str(r.y), r.late, round(r.x, 9)) for r in got) == sorted((str(i), str(c), str(y), late, round(want(i, c, late), 9)) for i, c, y, late in rows)


def test_ordered_statistics_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], "id long, c string, y double")
    assert encoding.ordered_statistics(empty, "c", "y", "id", "x").count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, None)], "id long, c string, y double")
    assert [r.x for r in encoding.ordered_statistics(blank, "c", "y", "id", "x").collect()] == [0.0, 0.0]


def test_no_fold_sees_its_own_labels(spark, cars):
    """Changing the labels of a fold leaves the statistics of its model as they were."""
    changed = cars.withColumn("y", F.when(F.col("fold") == 1, F.col("y") + 100).otherwise(F.col("y")))
    a, b = ({(r.id, r.brand_stat, r.model_stat) for r in encoded(x).where("for_fold = 1").collect()} for x in (cars, changed))
    assert {(i, round(x, 9), round(y, 9)) for i, x, y in a} == {(i, round(x, 9), round(y, 9)) for i, x, y in b} and len(a) == 1500


# --- boosted trees


def sketch(values, q):
    """The smallest value with a share q of the others at or below it."""
    s = sorted(values)
    return s[max(math.ceil(q * len(s)) - 1, 0)]


def brute(x, y, learn, q, trees, depth, rate, bins, least):
    """Trees by exhaustive search over (feature, bin), nodes as sets of rows."""
    edges = []
    for c in x.T:
        known = c[~np.isnan(c)]
        edges.append(sorted({sketch(known, k / (bins - 1)) for k in range(1, bins - 1)}))
    binned = np.array([[0 if np.isnan(v) else 1 + sum(e < v for e in edges[f]) for f, v in enumerate(r)] for r in x])
    mean = lambda v: sketch(v, q) if q is not None else sum(v) / len(v)
    p, splits = np.full(len(y), mean(y[learn])), []
    for _ in range(trees):
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                own = rows[learn[rows]]
                g = np.where(y[own] > p[own], q, q - 1) if q is not None else y[own] - p[own]
                best, found = 0, (0, bins - 1)
                for f in range(x.shape[1]):
                    for cut in range(bins - 1):
                        left = binned[own, f] <= cut
                        if left.sum() >= least and (~left).sum() >= least:
                            gain = round(g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(g), 9)
                            if gain > best:
                                best, found = gain, (f, cut)
                splits.append(found)
                go = binned[rows, found[0]] <= found[1]
                below += [rows[go], rows[~go]]
            nodes = below
        for rows in nodes:
            own = rows[learn[rows]]
            if len(own):
                p[rows] = p[rows] + rate * mean(y[own] - p[own])
    return p, splits


@pytest.mark.parametrize("q", [None, 0.1])
def test_trees_are_those_of_an_exhaustive_search(spark, q, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN_EVERY", 2)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(240, 3)), 1)
    x[::17, 1] = np.nan
    y = np.round(x[:, 0] * 2 + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=240), 3)
    rows = [(i, m, i % 3 == m, None if i == 5 else float(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(240) for m in (0, 1)]
    df = spark.createDataFrame(rows, "id long, for_fold int, held boolean, y double, a double, b double, c double").repartition(3)
    out, grown = boosting.boosted(df, "id", ["a", "b", "c"], "y", [0, 1, 7], quantile=q, trees=3, depth=2, rate=0.5, bins=6, least=5)
    got = {(r.model, r.id): r.predicted for r in out.collect()}
    for m in (0, 1):
        learn = np.array([i % 3 != m and i != 5 for i in range(240)])
        p, splits = brute(x, y, learn, q, 3, 2, 0.5, 6, 5)
        mine = [(int(t.feature[k]), int(t.cut[k])) for t in grown[m] for k in range(3)]
        assert mine == splits
        assert np.allclose([got[m, i] for i in range(240)], p)
    assert 7 not in grown


def test_quantile_floor_beats_the_percentile_of_a_group(spark, cars):
    scored = boosting.out_of_fold(encoded(cars), "id", FEATURES, "y", 3, quantile=0.1, trees=25, rate=0.2).join(cars.select("id", "y"), "id").cache()
    tiers = pricing.hierarchical(cars, "y", [["model_key"], ["brand"]], [0, 1, 2], 0.1)
    mine, theirs = (boosting.pinball_loss(x, F.col("y"), F.col("predicted"), 0.1).first() for x in (scored, tiers))
    assert mine.n == theirs.n == 1500 and mine.pinball < 0.7 * theirs.pinball
    floor = pricing.calibrated_floor(scored, "y", "predicted")
    share = evaluation.share_below(floor, F.col("y") + 1e-9, F.col("floor_log")).first().share
    assert abs(share - 0.1) <= 1 / 1500 + 1e-9


def test_mean_model_beats_the_median_of_a_group(spark, cars):
    scored = boosting.out_of_fold(encoded(cars), "id", FEATURES, "y", 3, trees=30, rate=0.2).join(cars.select("id", "y"), "id")
    tiers = pricing.hierarchical(cars, "y", [["model_key"], ["brand"]], [0, 1, 2])
    mine, theirs = (pricing.regression_metrics(x, F.exp("y"), F.exp("predicted")).first() for x in (scored, tiers))
    assert mine.mape < 0.75 * theirs.mape and mine.r2_log > theirs.r2_log


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, for_fold int, held boolean, y double, a double")
    out, grown = boosting.boosted(df, "id", ["a"], "y", [0])
    assert out.count() == 0 and grown == {}


def test_fold_metrics(spark):
    rows = [(0, 10.0, 12.0), (0, 20.0, 18.0), (1, 5.0, 5.0), (1, 8.0, 4.0)]
    df = spark.createDataFrame(rows, "fold int, y double, q double")
    got = {(r.method, r.fold): (r.n, round(r.mape, 6), round(r.mae, 6)) for r in evaluation.fold_metrics({"m": df, "b": df.where("fold = 1")}, F.col("y"), F.col("q")).collect()}
    assert got == {("m", 0): (2, 0.15, 2.0), ("m", 1): (2, 0.25, 2.0), ("m", None): (4, 0.2, 2.0), ("b", 1): (2, 0.25, 2.0), ("b", None): (2, 0.25, 2.0)}


@pytest.mark.parametrize("reach", [0.0, -0.3, 0.0005])
@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_a_bracket_that_misses_is_mended(spark, share, reach):
    """Brackets of no width, or turned inside out, with groups of one row, ties and negative infinity."""
    rng = random.Random(9)
    rows = [(k, rng.choice([rng.gauss(0, 1), 0.5])) for k in ("a", "b", None) for _ in range(101)] + [("one", 3.0), ("low", -math.inf), ("low", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    for lower in (False, True):
        got = {r.k: r.q for r in quantiles.group_quantile(df, ["k"], "x", share, large=True, lower=lower, whole=0, reach=reach).collect()}
        for k in ("a", "b", None, "one", "low"):
            v = sorted(x for g, x in rows if g == k)
            p = (len(v) - 1) * share
            a, b = v[math.floor(p)], v[math.ceil(p)]
            want = a if lower or a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b
            assert got[k] == pytest.approx(want)
        assert "none" not in got
        total = quantiles.group_quantile(df.where("x > -9"), [], "x", share, large=True, lower=True, whole=0, reach=reach).first().q
        v = sorted(x for _, x in rows if x is not None and x > -9)
        assert total == v[math.floor((len(v) - 1) * share)]


def test_size_is_known_without_a_job(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert not quantiles.is_large(df.join(df.withColumnRenamed("id", "b"), F.lit(True)).groupBy("id").count())
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_learning_curve_falls_as_more_is_learned_from(spark, cars):
    df = cars.withColumnRenamed("model_key", "car")
    curve = evaluation.learning_curve(df, "id", "id", ["age", "km"], ["brand", "car"], "y", 3, (0.0, 0.04, 0.5, 1.0), trees=12, rate=0.3).orderBy("share").collect()
    sizes = [pricing.sample_groups(df, "id", x).count() for x in (0.0, 0.04, 0.5, 1.0)]
    assert [r.share for r in curve] == [0.0, 0.04, 0.5, 1.0] and [r.n for r in curve] == sizes and sizes[-1] == 1500
    none, few, half, whole = (r.mape for r in curve)
    assert none is None and few > half > whole
    tiers = pricing.hierarchical(df, "y", [["car"], ["brand"]], [0, 1, 2])
    assert whole < 0.75 * pricing.regression_metrics(tiers, F.exp("y"), F.exp("predicted")).first().mape


def test_the_last_step_of_a_curve_is_the_model_of_all_rows(spark, cars):
    df = cars.withColumnRenamed("model_key", "car")
    last = evaluation.learning_curve(df, "id", "car", ["age"], ["brand"], "y", 3, (0.5, 1.0), trees=2).orderBy("share").collect()[-1]
    known = encoding.for_each_fold(df, ["brand"], "y", "id", 3)
    scored = boosting.out_of_fold(known, "id", ["age", "brand_stat"], "y", 3, trees=2).join(df.select("id", "y"), "id")
    # The bins of a feature are cut from the rows of all steps, so that they differ a little from those of one.
    assert last.mape == pytest.approx(pricing.regression_metrics(scored, F.exp("y"), F.exp("predicted")).first().mape, rel=0.02)
