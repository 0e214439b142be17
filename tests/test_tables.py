"""Partition-wise upserts leave other files alone; a ledger counts each batch once, whatever crashes."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lotwise.operators import status
from lotwise.plans.diagnose import diagnose
from lotwise.sources import partitioned
from lotwise.streaming import ledger, sightings


def files(path):
    return {p[len(path) :] for p in glob.glob(f"{path}/key_part=*/*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path):
    path = f"{tmp_path}/t"
    partitioned.create(spark.range(400).select("id", F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("n")), path, ["id"], 16)
    before = files(path)
    new = spark.createDataFrame([(3, "new", 7), (1000, "more", 8), (3, "newer", 9)], "id long, v string, n int").withColumn("at", F.monotonically_increasing_id())
    changed = partitioned.merge(spark, path, new, ["id"], 16, update=["v"], seq="n")
    after = files(path)
    assert 1 <= len(changed) <= 2 and {f.split("/")[1] for f in before - after} <= {f"key_part={p}" for p in changed} and len(before & after) >= 14
    got = {r.id: (r.v, r.n) for r in partitioned.read(spark, path).collect()}
    assert len(got) == 401 and got[3] == ("newer", 1) and got[1000] == ("more", 8) and got[4] == ("v4", 1)
    assert partitioned.merge(spark, path, new, ["id"], 16, update=["v"], seq="n") == [] and files(path) == after
    assert partitioned.merge(spark, path, new.limit(0), ["id"], 16) == []
    ignored = spark.createDataFrame([(4, "x", 0), (None, "null key", 0)], "id long, v string, n int")
    assert len(partitioned.merge(spark, path, ignored, ["id"], 16)) == 1
    got = partitioned.read(spark, path)
    assert got.count() == 402 and got.where("id = 4").first().v == "v4" and got.where("id is null").first().v == "null key"


def test_a_merge_that_failed_is_mended_by_repeating_it(spark, tmp_path):
    path = f"{tmp_path}/t"
    partitioned.create(spark.range(100).select("id", F.lit("old").alias("v")), path, ["id"], 8)
    new = spark.range(0, 200, 5).select("id", F.lit("new").alias("v"))
    partitioned.merge(spark, path, new, ["id"], 8, update=["v"])
    want = rows(partitioned.read(spark, path))
    undone = f"{tmp_path}/u"
    partitioned.create(spark.range(100).select("id", F.lit("old").alias("v")), undone, ["id"], 8)
    for p in ("key_part=1", "key_part=6"):  # as if two partitions had been moved in before the crash
        shutil.rmtree(f"{undone}/{p}")
        shutil.copytree(f"{path}/{p}", f"{undone}/{p}")
    partitioned.merge(spark, undone, new, ["id"], 8, update=["v"])
    assert rows(partitioned.read(spark, undone)) == want


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4).write.parquet(f"{path}/in")
    return f"{path}/in"


def test_a_batch_that_is_replayed_counts_once(spark, tmp_path, events):
    path, all_ = f"{tmp_path}/ledger", spark.read.parquet(events)
    write = ledger.writer(path, "q", "ts", "event_type", F.lit(1))

    class Crash(Exception):
        pass

    def crashes(at):
        def each(batch, number):
            if number != at:
                return write(batch, number)
            batch.limit(3).groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("used")).write.mode("overwrite").parquet(f"{path}/entries/query=q/batch={number}")
            raise Crash

        return each

    def stream():
        return spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 1).parquet(events)

    with pytest.raises(Exception, match="Crash"):
        sightings.drain(stream(), f"{tmp_path}/c", crashes(1))
    assert ledger.ledger(spark, path).agg(F.sum("used")).first()[0] < all_.count()
    sightings.drain(stream(), f"{tmp_path}/c", write)
    want = rows(all_.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("used")))
    assert rows(ledger.ledger(spark, path)) == want and ledger.committed(spark, path).count() == 4
    write(spark.read.parquet(sorted(glob.glob(f"{events}/*.parquet"), key=os.path.getmtime)[0]).limit(0), 99)
    assert rows(ledger.ledger(spark, path)) == want
    last = F.lit("2024-01-30").cast("date")
    of_week = status.day_ledger(all_, "ts", "event_type", F.lit(1), 7, last)
    assert rows(ledger.ledger(spark, path).where(F.datediff(last, "day").between(0, 6))) == rows(of_week)
    ledger.compact(spark, path, f"{tmp_path}/whole")
    assert rows(spark.read.parquet(f"{tmp_path}/whole").select("day", "kind", "used")) == want


def test_diagnose(spark):
    found = diagnose("ad_id", 3, {"a": spark.createDataFrame([(3, 1), (4, 2)], "ad_id int, x int"), "b": spark.range(2)})
    assert set(found) == {"a"} and found["a"].count() == 1
