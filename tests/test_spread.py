"""Work that one small file holds is dealt to all cores."""

from pyspark.sql import functions as F

from lotwise import queries


def tasks(df):
    """Tasks that made the rows."""
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_pages_made_of_small_rows_are_parsed_in_many_tasks(spark, tmp_path):
    rows = spark.range(1, 401).select(F.col("id").alias("p_partkey"), F.lit("name").alias("p_name"), F.lit("Brand").alias("p_brand"), F.lit("TYPE").alias("p_type"), F.lit(3).alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name, n in (("list_page_cards", 800), ("listing_page_facts", 400)):
        out = queries.QUERIES[name](spark, str(tmp_path))
        assert out.count() == n and tasks(out) > 8, name
    many = spark.range(100).repartition(40)
    assert queries.spread(many, "id").rdd.getNumPartitions() == 40
