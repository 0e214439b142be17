"""The stream of life cycles equals the batch, row for row, and forgets what is final."""

from datetime import timedelta

from pyspark.sql import functions as F

from lotwise.streaming import lifecycle, sightings


def test_stream_equals_batch(spark, tmp_path):
    all_ = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("event_type <> 'click'")
    all_ = all_.select((F.col("user_id") * 3 + F.col("event_id") % 3).alias("user_id"), "ts").unionByName(spark.sql("select cast(null as long) as user_id, timestamp'2024-01-02' as ts"))
    days = all_.where("user_id is not null").select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()
    for n, r in enumerate(days):  # a file for each day, in order
        all_.where(F.to_date("ts") == r.d).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    stream = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    waits, got, kept = (timedelta(days=1), timedelta(days=4)), [], []
    query = lifecycle.lifecycle(stream, "user_id", "ts", *waits).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    latest = all_.agg(F.max(F.unix_millis("ts"))).first()[0]
    want = [tuple(r) for r in lifecycle.lifecycle_batch(all_, "user_id", "ts", latest - 3_600_000, *waits).collect()]
    assert sorted(got) == sorted(want) and {r[2] for r in got} == {"seen", "stale", "final"}
    alive = all_.where("user_id is not null").groupBy("user_id").agg(F.max(F.unix_millis("ts")).alias("t")).where(F.col("t") + 4 * 86_400_000 >= latest - 3_600_000).count()
    assert kept[-1] == alive < all_.select("user_id").distinct().count()
