"""Tables, jobs, streams, and the shape of plans."""

from pyspark.sql import functions as F

from lotwise import queries
from lotwise.operators import status
from lotwise.sources import readers, sinks
from lotwise.streaming import sightings

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_and_joins(spark):
    assert "TakeOrderedAndProject" in plan(queries.robust_outlier_top(spark, SF))
    for name in ("photo_exact_pairs", "photo_near_pairs", "repost_corroborated"):
        text = plan(queries.QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_tables(spark, tmp_path):
    assert readers.table_or_empty(spark, "nowhere", "a int").columns == ["a"]
    assert readers.csv_or_empty(spark, f"{tmp_path}/none.csv", "a int").count() == 0
    df = spark.createDataFrame([(1, None, "a,b"), (2, 50, None)], "k int, n int, s string")
    sinks.export_csv(df, f"{tmp_path}/out")
    assert sorted(map(tuple, readers.csv(spark, f"{tmp_path}/out", "k int, n int, s string").collect())) == [(1, None, "a,b"), (2, 50, None)]
    sinks.migrate_csv(spark, df, "things", ["k"])
    sinks.merge_table(spark, "things", spark.createDataFrame([(2, 7, "z"), (3, 8, "y")], "k int, n int, s string"), ["k"], ["n"])
    assert sorted(map(tuple, spark.table("things").collect())) == [(1, None, "a,b"), (2, 7, None), (3, 8, "y")]
    spark.sql("DROP TABLE things")
    (tmp_path / "state.json").write_text('{"2024-01-01": {"a": 3}, "2024-01-02": {"b": 4}}')
    assert readers.day_state(spark, f"{tmp_path}/state.json").count() == 2
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.day_state(spark, f"{tmp_path}/bad.json").count() == 0
    a, b = (sinks.fingerprint(d, ["k", "s"]).first() for d in (df, df.orderBy(F.desc("k"))))
    assert a == b


def test_log_histogram_counts_every_row(spark, tmp_path):
    prices = [1.0, 10.0, 100.0, 799.0, 900.0, 950.0, 1000.0, 2500.0, 10000.0]
    df = spark.createDataFrame([(p,) for p in prices], "p_retailprice double")
    df.write.parquet(f"{tmp_path}/part.parquet")
    assert sum(r.n for r in queries.log_histogram(spark, str(tmp_path)).collect()) == len(prices)
    spanned = {r.bin: r.n for r in sinks.log_histogram(df, F.col("p_retailprice"), None, None, 4).collect()}
    assert spanned == {1: 1, 2: 1, 3: 4, 4: 3}
    assert [tuple(r) for r in sinks.log_histogram(df.limit(1), F.col("p_retailprice"), None, None, 4).collect()] == [(4, 1)]


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = []
    sightings.drain(sightings.daily_sightings(stream, "user_id", "ts", "60 days"), f"{tmp_path}/c1", lambda df, _: got.extend(df.select("user_id", "seen_date").collect()))
    want = status.daily_sightings(events.select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id").select("user_id", "seen_date").collect()
    assert sorted(got) == sorted(want)
    changes = []
    sightings.drain(sightings.status_changes(stream, "user_id", "event_id", "event_type"), f"{tmp_path}/c2", lambda df, _: changes.extend(df.collect()))
    last = {}
    for r in sorted(changes, key=lambda r: r.seq):
        last[r.key] = r.status
    assert last == {r.user_id: r.status for r in status.latest_status(events, "user_id", "event_id", "event_type").collect()}
