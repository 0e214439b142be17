"""Fallback tiers against plain loops, on null keys, null values, ties and clashing names, in small and in large tables."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import outliers, pricing, quantiles

SCHEMA = "id long, a string, b string, x double, fold int, n string, med int, c int"
Z_TIERS = [("fine", ["a", "b"]), ("a", ["a"]), ("all", [])]


def made(n=700):
    rng = random.Random(5)
    some = lambda values: rng.choice([*values, None])
    return [(i, some("pqr"), some("uvwxyz"), None if i % 13 == 0 else 3.0 if i % 3 == 0 else round(rng.gauss(9, 2), 2), i % 3, "n", 7, i) for i in range(n)]


def plain_z(data, least=8):
    out = {}
    for row in data:
        place = dict(zip(("id", "a", "b", "x"), row))
        out[row[0]] = (0.0, "")
        for name, keys in Z_TIERS:
            at = {"a": 1, "b": 2}
            if any(place[k] is None for k in keys):
                continue
            group = [r for r in data if all(r[at[k]] == place[k] for k in keys)]
            values = [r[3] for r in group if r[3] is not None]
            if len(group) < least:
                continue
            med = statistics.median(values) if values else None
            mad = statistics.median(abs(v - med) for v in values) if values else 0
            if mad == 0:
                out[row[0]] = (0.0, name)
                break
            if place["x"] is not None:
                out[row[0]] = (0.6745 * (place["x"] - med) / mad, name)
                break
            out[row[0]] = (None, name)
    return out


@pytest.fixture(params=["small", "large"])
def size(request, monkeypatch):
    if request.param == "large":
        monkeypatch.setattr(quantiles, "is_large", lambda df: True)
        monkeypatch.setattr(quantiles, "WHOLE_GROUP", 60)


def test_z_of_tiers_equals_a_plain_loop(spark, size):
    data = made()
    df = spark.createDataFrame(data, SCHEMA)
    out = outliers.hierarchical_z(df, "x", Z_TIERS)
    assert out.columns == [*df.columns, "price_z", "z_group_level"]
    got, want = {r.id: (r.price_z, r.z_group_level) for r in out.collect()}, plain_z(data)
    assert {i: level for i, (_, level) in got.items()} == {i: level for i, (_, level) in want.items()}
    assert {i: z for i, (z, _) in got.items()} == pytest.approx({i: z for i, (z, _) in want.items()}, abs=0.00501)
    assert {level for _, level in got.values()} >= {"fine", "a", "all"}
    assert outliers.hierarchical_z(df.limit(0), "x", Z_TIERS).count() == 0


def test_a_flat_finer_tier_serves_rows_without_a_value(spark):
    data = [(i, "p", "u", 3.0 if i else None, 0, "", 0, 0) for i in range(9)] + [(i, "p", "v", float(i) if i > 9 else None, 0, "", 0, 0) for i in range(9, 20)]
    got = {r.id: (r.price_z, r.z_group_level) for r in outliers.hierarchical_z(spark.createDataFrame(data, SCHEMA), "x", Z_TIERS[:2]).collect()}
    assert got[0] == (0.0, "fine") and got[9] == (None, "a") and got[19][1] == "fine"


@pytest.mark.parametrize("share", [0.1, 0.5])
def test_statistics_of_other_folds_equal_a_plain_loop(spark, size, share):
    data = made(400)
    out = pricing.hierarchical(spark.createDataFrame(data, SCHEMA), "x", [["a", "b"], ["b"]], [0, 1, 2, -1], share, learn=F.col("id") % 5 != 0)
    assert len(out.columns) == 9
    for r in out.collect():
        others = [d for d in data if d[3] is not None and d[0] % 5 and d[4] != r.fold]
        tiers = ([d[3] for d in others if (d[1], d[2]) == (r.a, r.b)], [d[3] for d in others if d[2] == r.b], [d[3] for d in others])
        assert r.predicted == pytest.approx(np.quantile(next(t for t in tiers if t), share), abs=1e-9)


def test_any_aggregate_and_a_fold_that_none_asked_for(spark):
    df = spark.createDataFrame(made(60), SCHEMA)
    got = {r.id: r for r in pricing.hierarchical(df, "x", [], [0, 1], F.avg).collect()}
    want = np.mean([d[3] for d in made(60) if d[3] is not None and d[4] != 1])
    assert got[1].predicted == pytest.approx(want) and got[2].predicted is None
    assert pricing.hierarchical(df.limit(0), "x", [["a"]], [0, 1]).count() == 0
