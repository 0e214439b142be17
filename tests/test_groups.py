"""Groups of near picture hashes against brute force."""

import random

import pytest

from lotwise.operators import duplicates, groups


def brute(rows, most):
    rows = sorted({(i, b) for i, b in rows if i is not None}, key=str)
    link = [[x != y and x[1] is not None and y[1] is not None and ((x[1] ^ y[1]) & (2**64 - 1)).bit_count() <= most for y in rows] for x in rows]
    out = []
    for k, (i, b) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            at = todo.pop()
            more = [j for j, x in enumerate(link[at]) if x and j not in reach]
            reach.update(more)
            todo += more
        out.append((i, b, min(j for j, c in rows if c == b) if b is not None else i, min(rows[j][0] for j in reach), sum(link[k])))
    return out


@pytest.mark.parametrize("most", [0, 3, 8])
def test_hash_groups(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(25)]
    rows = [(rng.randrange(150), rng.choice(base) ^ sum(1 << rng.randrange(62) for _ in range(rng.randrange(4)))) for _ in range(160)]
    chain = [(1000 + k, (1 << (2 * k)) - 1) for k in range(16)]  # linked end to end at a distance of 2
    rows += [(200 + k, base[0]) for k in range(40)] + chain + [(7, None), (None, 5), (3, -1), (4, -1), (4, -1)]
    got = groups.hash_groups(spark.createDataFrame(rows, "ad_id long, bits long").repartition(3), most)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, most), key=str)
    assert groups.hash_groups(spark.createDataFrame([], "ad_id long, bits long"), most).count() == 0


def test_nearest_pairs(spark):
    rows = [(1, 0), (2, 1), (3, 3), (4, 255), (50, 7), (100, 0), (150, None)]
    df = spark.createDataFrame(rows, "ad_id long, bits long")
    got = groups.nearest_pairs(df, 3, df.where("ad_id % 50 = 0"), 4)
    assert list(map(tuple, got.collect())) == [(1, 100, 0), (2, 100, 1), (3, 50, 1), (2, 50, 2)]


def test_probes_are_not_broadcast(spark):
    """Each hash has hundreds of probes, which Spark takes for one row: broadcast, they would fill the driver."""
    hashes = spark.createDataFrame([(k * 7919,) for k in range(50)], "bits long")
    for asked in (None, hashes.limit(5)):
        text = duplicates.near_hashes(hashes, 8, 32, asked=asked)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
