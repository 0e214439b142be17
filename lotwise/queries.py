"""Every operator bound to the test tables, and the same in SQL.

A table plays a role: `part` the listings, `events` the observations and the
status journal, `orders` and `lineitem` sales, `embeddings` picture hashes,
`documents` and `pages` texts, `labels` verdicts, `conversations` a journal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.config import Config
from lotwise.functions import scalars as S
from lotwise.functions import text as X
from lotwise.operators import boosting, duplicates, encoding, evaluation, folded, forest, groups, outliers, pricing, quantiles, queues, review, rules, status, summary, upserts
from lotwise.plans.clean import TIERS, clean, two_passes
from lotwise.sources import pages, sinks, working

QUERIES = {}
ORACLE_SQL = {}
CFG = Config()
AS_OF = "2024-02-01"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, a_core: int = 4) -> DataFrame:
    """The rows dealt by a key to some tasks for each core, where the files make fewer: for small rows with much work each."""
    n = a_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


# --- listings: rules and outliers -------------------------------------------------------------------------------

LISTING = """
    SELECT p_partkey AS ad_id, p_name AS title, p_brand AS brand, p_type AS model, p_size AS age,
        CASE WHEN p_partkey % 17 <> 0 THEN CAST(2027 - p_size AS DOUBLE) END AS year,
        CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice * 1000 * (1 + p_partkey % 5) END AS price_tenge,
        CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 7919) % 1100000 - (CASE WHEN p_partkey % 7 = 0 THEN (p_partkey * 7919) % 1100000 ELSE 0 END) AS DOUBLE) END AS mileage_km,
        CASE p_partkey % 3 WHEN 0 THEN 'новый' WHEN 1 THEN 'б/у' END AS condition,
        CASE p_partkey % 4 WHEN 0 THEN 'От дилера' WHEN 1 THEN 'Официальный дилер|VIP' WHEN 2 THEN 'VIP' END AS labels,
        CASE p_partkey % 3 WHEN 0 THEN 'Red metallic' WHEN 1 THEN 'red' WHEN 2 THEN NULL END AS color,
        CASE WHEN p_partkey % 6 = 0 THEN 'срочно продаю' WHEN p_partkey % 6 = 1 THEN p_name END AS description
    FROM part"""
BUCKET = "CASE WHEN age <= 0 THEN NULL WHEN age <= 3 THEN '0-3' WHEN age <= 7 THEN '4-7' WHEN age <= 12 THEN '8-12' WHEN age <= 20 THEN '13-20' WHEN age > 20 THEN '20+' END"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    km = (key * 7919) % 1_100_000
    return read(spark, sf_dir, "part").select(
        key.alias("ad_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.col("p_size").alias("age"),
        F.when(key % 17 != 0, (2027 - F.col("p_size")).cast("double")).alias("year"),
        F.when(key % 13 != 0, F.col("p_retailprice") * 1000 * (1 + key % 5)).alias("price_tenge"),
        F.when(key % 11 != 0, F.when(key % 7 == 0, 0).otherwise(km).cast("double")).alias("mileage_km"),
        F.when(key % 3 == 0, "новый").when(key % 3 == 1, "б/у").alias("condition"),
        F.when(key % 4 == 0, "От дилера").when(key % 4 == 1, "Официальный дилер|VIP").when(key % 4 == 2, "VIP").alias("labels"),
        F.when(key % 3 == 0, "Red metallic").when(key % 3 == 1, "red").alias("color"),
        F.when(key % 6 == 0, "срочно продаю").when(key % 6 == 1, F.col("p_name")).alias("description"),
    )


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ad_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.col("p_size").alias("age"), F.col("p_retailprice").alias("price"))
    return rows.withColumns({"log_price": F.ln("price"), "age_bucket": S.age_bucket(F.col("age")), "model_key": S.model_key(F.col("brand"), F.col("model"))})


PRICED = f"priced AS (SELECT p_partkey AS ad_id, p_brand AS brand, p_type AS model, p_size AS age, p_retailprice AS price, ln(p_retailprice) AS log_price, {BUCKET.replace('age', 'p_size')} AS age_bucket, p_brand || ' ' || p_type AS model_key FROM part)"
SCORED = f"""WITH {PRICED},
    a AS (SELECT *, median(log_price) OVER m AS m1, count(*) OVER m AS n1, median(log_price) OVER b AS m2, count(*) OVER b AS n2, median(log_price) OVER g AS m3, count(*) OVER g AS n3
        FROM priced WINDOW m AS (PARTITION BY model_key, age_bucket), b AS (PARTITION BY brand, age_bucket), g AS (PARTITION BY age_bucket)),
    d AS (SELECT *, median(abs(log_price - m1)) OVER (PARTITION BY model_key, age_bucket) AS d1, median(abs(log_price - m2)) OVER (PARTITION BY brand, age_bucket) AS d2, median(abs(log_price - m3)) OVER (PARTITION BY age_bucket) AS d3 FROM a),
    z AS (SELECT *, CASE WHEN n1 >= 8 THEN 'model' WHEN n2 >= 8 THEN 'brand' WHEN n3 >= 8 THEN 'age' ELSE '' END AS z_group_level,
        CASE WHEN n1 >= 8 THEN CASE WHEN d1 = 0 THEN 0 ELSE 0.6745 * (log_price - m1) / d1 END WHEN n2 >= 8 THEN CASE WHEN d2 = 0 THEN 0 ELSE 0.6745 * (log_price - m2) / d2 END
            WHEN n3 >= 8 THEN CASE WHEN d3 = 0 THEN 0 ELSE 0.6745 * (log_price - m3) / d3 END ELSE 0 END AS raw FROM d),
    scored AS (SELECT *, round_even(raw * 100, 0) / 100 AS price_z FROM z)"""


@query(f"{SCORED} SELECT ad_id, round(price_z, 2) + 0.0 AS price_z, z_group_level, CASE WHEN price_z < -3.5 THEN 'price_anomaly_low' WHEN price_z > 3.5 THEN 'price_anomaly_high' ELSE '' END AS stat_reasons FROM scored")
def robust_outliers(spark, sf_dir):
    out = outliers.hierarchical_z(priced(spark, sf_dir), "log_price", TIERS)
    return out.select("ad_id", (F.round("price_z", 2) + 0.0).alias("price_z"), "z_group_level", outliers.stat_reasons(F.col("price_z")).alias("stat_reasons"))


@query(f"{SCORED} SELECT ad_id, brand, model, price, round(price_z, 2) AS price_z FROM scored WHERE abs(price_z) > 3.5 ORDER BY price_z, ad_id LIMIT 15")
def robust_outlier_top(spark, sf_dir):
    out = outliers.hierarchical_z(priced(spark, sf_dir), "log_price", TIERS).where(F.abs("price_z") > CFG.z_threshold)
    return outliers.top(out, 15, F.col("price_z"), F.col("ad_id")).select("ad_id", "brand", "model", "price", F.round("price_z", 2).alias("price_z"))


RULES = f"""WITH l AS ({LISTING}), ruled AS (SELECT *, concat_ws('|',
        CASE WHEN year < 1950 THEN 'year_too_old' END, CASE WHEN year > 2027 THEN 'year_in_future' END, CASE WHEN price_tenge < 200000 THEN 'price_too_low' END,
        CASE WHEN price_tenge > 300000000 THEN 'price_too_high' END, CASE WHEN mileage_km > 1000000 THEN 'mileage_extreme' END,
        CASE WHEN condition = 'б/у' AND mileage_km = 0 AND age >= 2 THEN 'used_but_zero_mileage' END,
        CASE WHEN CASE WHEN age = 0 THEN mileage_km > 0 ELSE mileage_km / nullif(age, 0) > 100000 END THEN 'km_per_year_extreme' END,
        CASE WHEN age <= 4 AND price_tenge < 4000000 AND condition <> 'новый' THEN 'young_car_cheap' END) AS reasons FROM l)"""


def _ruled(spark, sf_dir):
    c = F.col
    return listings(spark, sf_dir).withColumn("reasons", rules.hard_rules(c("year"), c("price_tenge"), c("mileage_km"), c("age"), c("condition")))


@query(f"{RULES} SELECT ad_id, reasons, CAST(reasons <> '' AS INTEGER) AS is_suspicious FROM ruled")
def hard_rule_reasons(spark, sf_dir):
    out = rules.finalize(_ruled(spark, sf_dir).withColumnRenamed("reasons", "rule_reasons"))
    return out.select("ad_id", F.col("suspicion_reasons").alias("reasons"), "is_suspicious")


@query(f"{RULES} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM ruled WHERE reasons <> '') GROUP BY reason")
def reason_counts(spark, sf_dir):
    return review.reason_counts(_ruled(spark, sf_dir), F.col("reasons"))


@query(f"{RULES} SELECT reasons AS flags, count(*) AS n FROM ruled WHERE reasons <> '' GROUP BY reasons")
def info_counts(spark, sf_dir):
    return review.whole_counts(_ruled(spark, sf_dir), F.col("reasons"))


@query(f"WITH l AS ({LISTING}) SELECT ad_id, CAST(mileage_km IS NULL AS INTEGER) AS is_mileage_missing, CAST(description IS NULL AS INTEGER) AS is_description_missing FROM l")
def missing_indicators(spark, sf_dir):
    return rules.missing_indicators(listings(spark, sf_dir), {"mileage_km": "is_mileage_missing", "description": "is_description_missing"}).select("ad_id", "is_mileage_missing", "is_description_missing")


@query(f"""WITH l AS ({LISTING}), s AS (SELECT count(*) AS n, count(*) - count(year) AS a, count(*) - count(price_tenge) AS b, count(*) - count(mileage_km) AS c, count(*) - count(condition) AS d, count(*) - count(labels) AS e, count(*) - count(description) AS f, count(*) - count(color) AS g FROM l),
    u AS (SELECT unnest(['year', 'price_tenge', 'mileage_km', 'condition', 'labels', 'description', 'color']) AS column_name, unnest([a, b, c, d, e, f, g]) AS k, n FROM s)
    SELECT column_name, round(CAST(k AS DOUBLE) / n * 100, 4) AS null_pct FROM u ORDER BY null_pct DESC, column_name LIMIT 6""")
def null_profile(spark, sf_dir):
    return status.null_profile(listings(spark, sf_dir), ["year", "price_tenge", "mileage_km", "condition", "labels", "description", "color"], 6)


FENCED = f"""{SCORED}, q AS (SELECT age_bucket, quantile_cont(log_price, 0.25) AS q1, quantile_cont(log_price, 0.75) AS q3 FROM priced WHERE age_bucket IS NOT NULL GROUP BY age_bucket),
    fenced AS (SELECT s.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM scored s LEFT JOIN q USING (age_bucket))"""


def _fenced(spark, sf_dir):
    return outliers.iqr_fences(outliers.hierarchical_z(priced(spark, sf_dir), "log_price", TIERS), "log_price", "age_bucket")


@query(f"{FENCED} SELECT ad_id, round(lo, 6) AS iqr_low, round(hi, 6) AS iqr_high, CASE WHEN log_price < lo THEN 'low' WHEN log_price > hi THEN 'high' ELSE '' END AS iqr_flag FROM fenced")
def iqr_fences(spark, sf_dir):
    return _fenced(spark, sf_dir).select("ad_id", F.round("iqr_low", 6).alias("iqr_low"), F.round("iqr_high", 6).alias("iqr_high"), "iqr_flag")


@query(f"{FENCED} SELECT count(*) FILTER (WHERE price_z < -3.5) AS z_low, count(*) FILTER (WHERE log_price < lo) AS iqr_low, count(*) FILTER (WHERE price_z < -3.5 AND log_price < lo) AS both_low FROM fenced")
def detector_agreement(spark, sf_dir):
    z, q = F.col("price_z") < -CFG.z_threshold, F.col("iqr_flag") == "low"
    return _fenced(spark, sf_dir).agg(F.count_if(z).alias("z_low"), F.count_if(q).alias("iqr_low"), F.count_if(z & q).alias("both_low"))


@query(f"WITH {PRICED} SELECT age_bucket, count(*) AS n, round(median(price), 6) AS median_price FROM priced GROUP BY age_bucket")
def age_bucket_medians(spark, sf_dir):
    rows = priced(spark, sf_dir)
    counts = rows.groupBy(F.col("age_bucket").alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    medians = quantiles.group_quantile(rows, ["age_bucket"], "price", 0.5)
    return counts.join(medians, F.col("_k").eqNullSafe(F.col("age_bucket")), "left").select(F.col("_k").alias("age_bucket"), "n", F.round("q", 6).alias("median_price"))


EXCULPATED = f"""WITH l AS ({LISTING}),
    i AS (SELECT l.*, CASE WHEN ad_id % 2 = 0 THEN 'price_anomaly_low' WHEN ad_id % 5 = 0 THEN 'price_anomaly_high' ELSE '' END AS stat,
        CASE WHEN ad_id % 3 = 1 THEN 'price_too_low|young_car_cheap' WHEN ad_id % 3 = 2 THEN 'young_car_cheap' ELSE '' END AS rule,
        coalesce(contains(lower(d.text), 'idiot') OR contains(lower(d.text), 'trash'), false) OR coalesce(x.toxic = 0 AND x.quality = 0, false) OR ad_id % 19 = 0 AS explained,
        coalesce(x.toxic = 1, false) AS fraud, CASE WHEN ad_id % 8 = 0 THEN price_tenge * 1.1 END AS market
        FROM l LEFT JOIN documents d ON d.doc_id = ad_id LEFT JOIN labels x ON x.doc_id = ad_id),
    s AS (SELECT *, stat = 'price_anomaly_low' AND explained AS c1, contains(rule, 'young_car_cheap') AND explained AS c2,
        stat = 'price_anomaly_low' AND NOT explained AND (coalesce(condition = 'новый', false) OR coalesce(contains(lower(labels), 'официальный дилер'), false)) AS c3 FROM i),
    t AS (SELECT *, stat = 'price_anomaly_low' AND NOT c1 AND NOT c3 AND coalesce(market > 0 AND price_tenge >= 0.8 * market, false) AS c4 FROM s),
    u AS (SELECT *, CASE WHEN c1 OR c3 OR c4 THEN '' WHEN stat = 'price_anomaly_low' AND coalesce(contains(description, 'срочн'), false) THEN 'price_anomaly_low|cheap_and_urgent' ELSE stat END AS stat2 FROM t)
    SELECT ad_id, CASE WHEN fraud AND stat2 = '' THEN 'confirmed_by_review' ELSE stat2 END AS stat_reasons,
        CASE WHEN c2 THEN CASE WHEN rule = 'young_car_cheap' THEN '' ELSE 'price_too_low' END ELSE rule END AS rule_reasons,
        concat_ws('|', CASE WHEN c1 OR c2 THEN 'low_price_explained' END, CASE WHEN c3 THEN 'dealer_financing_price' END, CASE WHEN c4 THEN 'market_price_ok' END) AS info_flags FROM u"""


@query(EXCULPATED)
def exculpate_flags(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    key, toxic, good = F.col("ad_id"), F.col("toxic"), F.col("quality")
    rows = listings(spark, sf_dir).join(docs.select(F.col("doc_id").alias("ad_id"), F.col("text").alias("text_full")), "ad_id", "left").join(labels.select(F.col("doc_id").alias("ad_id"), "toxic", "quality"), "ad_id", "left")
    rows = rows.withColumns({
        "stat_reasons": F.when(key % 2 == 0, "price_anomaly_low").when(key % 5 == 0, "price_anomaly_high").otherwise(""),
        "rule_reasons": F.when(key % 3 == 1, "price_too_low|young_car_cheap").when(key % 3 == 2, "young_car_cheap").otherwise(""),
        "verdict": F.when(toxic == 1, "fraud").when((toxic == 0) & (good == 0), "legit"),
        "customs_cleared": F.when(key % 19 == 0, "Нет"),
        "market_price": F.when(key % 8 == 0, F.col("price_tenge") * 1.1),
    })
    hit = lambda t: F.contains(F.lower(t), F.lit("idiot")) | F.contains(F.lower(t), F.lit("trash"))
    return rules.exculpate(rows, damage=hit).select("ad_id", "stat_reasons", "rule_reasons", "info_flags")


@query(f"""WITH l AS ({LISTING}), r AS (SELECT ad_id, title, brand, model, CAST((ad_id % 3) * 2000 AS DOUBLE) AS km, split_part(lower(trim(color)), ' ', 1) AS c, trim(description) AS d,
        coalesce(condition = 'новый', false) OR coalesce(contains(labels, 'От дилера') OR contains(labels, 'Новая'), false) AS dealer, count(*) OVER (PARTITION BY title, brand, model) AS n FROM l),
    p AS (SELECT DISTINCT a.title, a.brand, a.model FROM r a JOIN r b ON a.title = b.title AND a.brand = b.brand AND a.model = b.model AND a.ad_id < b.ad_id
        WHERE a.n BETWEEN 2 AND 5 AND NOT a.dealer AND NOT b.dealer AND (a.c IS NULL OR b.c IS NULL OR a.c = b.c) AND ((a.km = b.km AND a.km > 1000) OR (a.d = b.d AND a.d <> '')))
    SELECT ad_id, CASE WHEN n > 1 AND NOT dealer AND p.title IS NOT NULL THEN 'repost_corroborated' ELSE '' END AS dup_reasons,
        CASE WHEN n > 1 AND NOT dealer AND p.title IS NULL THEN 'same_title_year_price' ELSE '' END AS info_flags FROM r LEFT JOIN p USING (title, brand, model)""")
def repost_corroborated(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("mileage_km", ((F.col("ad_id") % 3) * 2000).cast("double"))
    return duplicates.reposts(rows, keys=("title", "brand", "model")).select("ad_id", "dup_reasons", "info_flags")


BITS = "hashes AS (SELECT vec_id AS ad_id, (SELECT sum(CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END) FROM (SELECT unnest(range(1, {n} + 1)) AS i)) AS bits FROM embeddings)"

#: The clean layer step by step, as `clean` takes them.  A row without a price falls through the tiers; one without a year has no tier.
CLEANED = f"""l AS ({LISTING}),
    raw AS (SELECT ad_id, title, trim(brand) AS brand, trim(model) AS model, year, price_tenge, mileage_km, condition, labels, description, 2027 - year AS age FROM l),
    facts AS (SELECT raw.*, ln(price_tenge) AS v, brand || ' ' || model AS model_key, {BUCKET} AS age_bucket, coalesce(UNCLEARED, false) AS uncleared, MARKET AS market,
        coalesce(x.doc_id IS NOT NULL AND coalesce(x.toxic, 0) <> 1, false) AS legit, coalesce(x.toxic = 1, false) AS fraud FROM raw LEFT JOIN labels x ON x.doc_id = ad_id),
    ruled AS (SELECT *, concat_ws('|',
        CASE WHEN year < 1950 THEN 'year_too_old' END, CASE WHEN year > 2027 THEN 'year_in_future' END, CASE WHEN price_tenge < 200000 THEN 'price_too_low' END,
        CASE WHEN price_tenge > 300000000 THEN 'price_too_high' END, CASE WHEN mileage_km > 1000000 THEN 'mileage_extreme' END,
        CASE WHEN condition = 'б/у' AND mileage_km = 0 AND age >= 2 THEN 'used_but_zero_mileage' END,
        CASE WHEN CASE WHEN age = 0 THEN mileage_km > 0 ELSE mileage_km / nullif(age, 0) > 100000 END THEN 'km_per_year_extreme' END,
        CASE WHEN age <= 4 AND price_tenge < 4000000 AND condition <> 'новый' THEN 'young_car_cheap' END) AS rule FROM facts),
    med AS (SELECT *, median(v) OVER m AS m1, count(*) OVER m AS n1, median(v) OVER b AS m2, count(*) OVER b AS n2, median(v) OVER g AS m3, count(*) OVER g AS n3
        FROM ruled WINDOW m AS (PARTITION BY model_key, age_bucket), b AS (PARTITION BY brand, age_bucket), g AS (PARTITION BY age_bucket)),
    mad AS (SELECT *, median(abs(v - m1)) OVER (PARTITION BY model_key, age_bucket) AS d1, median(abs(v - m2)) OVER (PARTITION BY brand, age_bucket) AS d2, median(abs(v - m3)) OVER (PARTITION BY age_bucket) AS d3 FROM med),
    own AS (SELECT *, age_bucket IS NOT NULL AND n1 >= 8 AS k1, age_bucket IS NOT NULL AND n2 >= 8 AS k2, age_bucket IS NOT NULL AND n3 >= 8 AS k3, CASE WHEN coalesce(d1, 0) = 0 THEN 0 ELSE 0.6745 * (v - m1) / d1 END AS o1,
        CASE WHEN coalesce(d2, 0) = 0 THEN 0 ELSE 0.6745 * (v - m2) / d2 END AS o2, CASE WHEN coalesce(d3, 0) = 0 THEN 0 ELSE 0.6745 * (v - m3) / d3 END AS o3 FROM mad),
    t1 AS (SELECT *, CASE WHEN k1 THEN o1 END AS z1, CASE WHEN k1 THEN 'model' END AS l1 FROM own),
    t2 AS (SELECT *, CASE WHEN k2 AND z1 IS NULL THEN o2 ELSE z1 END AS z2, CASE WHEN k2 AND z1 IS NULL THEN 'brand' ELSE l1 END AS l2 FROM t1),
    t3 AS (SELECT *, CASE WHEN k3 AND z2 IS NULL THEN o3 ELSE z2 END AS z3, CASE WHEN k3 AND z2 IS NULL THEN 'age' ELSE l2 END AS l3 FROM t2),
    scored AS (SELECT *, coalesce(l3, '') AS z_group_level, CASE WHEN l3 IS NULL THEN 0 ELSE round_even(z3 * 100, 0) / 100 END AS z FROM t3),
    said AS (SELECT *, CASE WHEN z < -3.5 THEN 'price_anomaly_low' WHEN z > 3.5 THEN 'price_anomaly_high' ELSE '' END AS stat, uncleared OR legit AS explained FROM scored),
    e1 AS (SELECT *, stat = 'price_anomaly_low' AND explained AS c1, contains(rule, 'young_car_cheap') AND explained AS c2,
        stat = 'price_anomaly_low' AND NOT explained AND (coalesce(condition = 'новый', false) OR coalesce(contains(lower(labels), 'официальный дилер'), false)) AS c3 FROM said),
    e2 AS (SELECT *, stat = 'price_anomaly_low' AND NOT c1 AND NOT c3 AND coalesce(market > 0 AND price_tenge >= 0.8 * market, false) AS c4 FROM e1),
    e3 AS (SELECT *, CASE WHEN c1 OR c3 OR c4 THEN '' WHEN stat = 'price_anomaly_low' AND coalesce(contains(lower(description), 'срочн'), false) THEN 'price_anomaly_low|cheap_and_urgent' ELSE stat END AS left_ FROM e2),
    e4 AS (SELECT *, CASE WHEN fraud AND left_ = '' THEN 'confirmed_by_review' ELSE left_ END AS stat_reasons, CASE WHEN c2 THEN array_to_string(list_filter(string_split(rule, '|'), lambda x: x <> 'young_car_cheap'), '|') ELSE rule END AS rule_reasons,
        coalesce(condition = 'новый', false) OR coalesce(contains(labels, 'От дилера') OR contains(labels, 'Новая'), false) AS dealer, count(*) OVER (PARTITION BY title, year, price_tenge) AS shared, trim(description) AS d FROM e3),
    strong AS (SELECT DISTINCT a.title, a.year, a.price_tenge FROM e4 a JOIN e4 b ON a.title = b.title AND a.year = b.year AND a.price_tenge = b.price_tenge AND a.ad_id < b.ad_id
        WHERE a.shared <= 5 AND NOT a.dealer AND NOT b.dealer AND ((a.mileage_km = b.mileage_km AND a.mileage_km > 1000) OR (a.d = b.d AND a.d <> ''))),
    f1 AS (SELECT e4.*, shared > 1 AND NOT dealer AND s.title IS NOT NULL AS repost, shared > 1 AND NOT dealer AND s.title IS NULL AS alike FROM e4 LEFT JOIN strong s USING (title, year, price_tenge)),
    ends AS (SELECT ad_id_a AS e FROM pairs UNION SELECT ad_id_b FROM pairs), seen AS (SELECT user_id, arg_max(event_type, event_id) AS st FROM events GROUP BY user_id),
    cleaned AS (SELECT ad_id, round(z, 2) + 0.0 AS price_z, z_group_level, concat_ws('|', CASE WHEN c1 OR c2 THEN 'low_price_explained' END, CASE WHEN c3 THEN 'dealer_financing_price' END, CASE WHEN c4 THEN 'market_price_ok' END, CASE WHEN alike THEN 'same_title_year_price' END) AS info_flags,
        concat_ws('|', nullif(rule_reasons, ''), nullif(stat_reasons, ''), CASE WHEN repost THEN 'repost_corroborated' END, CASE WHEN e IS NOT NULL THEN 'photo_of_another_object' END) AS suspicion_reasons, coalesce(st, 'active') AS status
        FROM f1 LEFT JOIN ends ON e = ad_id LEFT JOIN seen ON user_id = ad_id)"""


@query(f"WITH {BITS.format(n=16)}, pairs AS (SELECT a.ad_id AS ad_id_a, b.ad_id AS ad_id_b FROM hashes a JOIN hashes b ON a.bits = b.bits AND a.ad_id < b.ad_id), {CLEANED.replace("UNCLEARED", "ad_id % 19 = 0").replace("MARKET", "CASE WHEN ad_id % 8 = 0 THEN price_tenge * 1.1 END")} SELECT ad_id, price_z, z_group_level, info_flags, suspicion_reasons, CAST(suspicion_reasons <> '' AS INTEGER) AS is_suspicious, status FROM cleaned")
def clean_layer(spark, sf_dir):
    """The whole pipeline of the clean layer over listings, page facts, verdicts, statuses and picture pairs."""
    raw = listings(spark, sf_dir).drop("age").withColumns({"city": F.lit("A"), "engine_volume": F.lit(2.0)})
    enriched = raw.select("ad_id", F.when(F.col("ad_id") % 19 == 0, "Нет").alias("customs_cleared"), F.when(F.col("ad_id") % 8 == 0, F.col("price_tenge") * 1.1).alias("market_price"))
    journal = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ad_id"), F.col("doc_id").alias("seq"), F.when(F.col("toxic") == 1, "fraud").otherwise("legit").alias("verdict"))
    seen = status.latest_status(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type").withColumnRenamed("user_id", "ad_id")
    pairs = photo_exact_pairs(spark, sf_dir)
    out = clean(raw.drop("color"), enriched, journal, seen, pairs)
    return out.select("ad_id", (F.round("price_z", 2) + 0.0).alias("price_z"), "z_group_level", "info_flags", "suspicion_reasons", "is_suspicious", "status")


# --- pictures ---------------------------------------------------------------------------------------------------



def _bits(spark, sf_dir, n):
    """The signs of the first components as the bits of a number."""
    bits = F.aggregate(F.transform(F.slice("embedding", 1, n), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.lit(0).cast("long"))), F.struct(F.expr("0L").alias("v"), F.expr("1L").alias("p")), lambda a, x: F.struct((a["v"] + a["p"] * x).alias("v"), (a["p"] * 2).alias("p")), lambda a: a["v"])
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ad_id"), bits.alias("bits"))


@query(f"WITH {BITS.format(n=16)} SELECT a.ad_id AS ad_id_a, b.ad_id AS ad_id_b, 0 AS hamming_distance FROM hashes a JOIN hashes b ON a.bits = b.bits AND a.ad_id < b.ad_id")
def photo_exact_pairs(spark, sf_dir):
    return duplicates.same_hash_pairs(_bits(spark, sf_dir, 16), hash_col="bits")


@query(f"WITH {BITS.format(n=32)} SELECT a.ad_id AS ad_id_a, b.ad_id AS ad_id_b, CAST(bit_count(xor(CAST(a.bits AS BIGINT), CAST(b.bits AS BIGINT))) AS INTEGER) AS hamming_distance FROM hashes a JOIN hashes b ON a.ad_id < b.ad_id WHERE bit_count(xor(CAST(a.bits AS BIGINT), CAST(b.bits AS BIGINT))) <= 8")
def photo_near_pairs(spark, sf_dir):
    return duplicates.near_hash_pairs(_bits(spark, sf_dir, 32), 8, width=32)


@query(f"""WITH RECURSIVE {BITS.format(n=60)},
    links AS MATERIALIZED (SELECT a.ad_id AS x, b.ad_id AS y FROM hashes a JOIN hashes b ON a.ad_id <> b.ad_id WHERE bit_count(xor(CAST(a.bits AS BIGINT), CAST(b.bits AS BIGINT))) <= 12),
    reach(x, y) AS (SELECT ad_id, ad_id FROM hashes UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
    degree AS (SELECT x AS ad_id, count(*) AS n FROM links GROUP BY x), same AS (SELECT bits, min(ad_id) AS representative FROM hashes GROUP BY bits)
    SELECT h.ad_id, representative, min(y) AS group_id, coalesce(max(n), 0) AS n_links FROM hashes h JOIN same USING (bits) JOIN reach ON x = h.ad_id LEFT JOIN degree d ON d.ad_id = h.ad_id GROUP BY h.ad_id, representative""")
def photo_groups(spark, sf_dir):
    """Groups of pictures within 12 of 60 bits, a row for each picture."""
    return groups.hash_groups(_bits(spark, sf_dir, 60), 12, width=60, bands=5).drop("bits")


@query(f"""WITH {BITS.format(n=32)} SELECT least(a.ad_id, b.ad_id) AS ad_id_a, greatest(a.ad_id, b.ad_id) AS ad_id_b, CAST(min(bit_count(xor(CAST(a.bits AS BIGINT), CAST(b.bits AS BIGINT)))) AS INTEGER) AS hamming_distance
    FROM hashes a JOIN hashes b ON a.ad_id <> b.ad_id WHERE a.ad_id % 50 = 0 AND bit_count(xor(CAST(a.bits AS BIGINT), CAST(b.bits AS BIGINT))) <= 8 GROUP BY 1, 2 ORDER BY hamming_distance, ad_id_a, ad_id_b LIMIT 40""")
def photo_nearest_pairs(spark, sf_dir):
    """The nearest pairs of every fiftieth picture with any other, by distance."""
    bits = _bits(spark, sf_dir, 32)
    return groups.nearest_pairs(bits, 8, bits.where("ad_id % 50 = 0"), 40, width=32)


@query(f"""WITH {BITS.format(n=16)}, pairs AS (SELECT a.ad_id AS x, b.ad_id AS y FROM hashes a JOIN hashes b ON a.bits = b.bits AND a.ad_id < b.ad_id), l AS ({LISTING}),
    c AS (SELECT ad_id, trim(brand || ' ' || model) AS k, price_tenge AS p, year AS y, coalesce(condition = 'новый', false) OR coalesce(contains(lower(labels), 'дилер') OR contains(lower(labels), 'новая'), false) AS dealer FROM l)
    SELECT x AS ad_id_a, pairs.y AS ad_id_b, 0 AS hamming_distance, a.k AS model_key_a, a.p AS price_a, a.y AS year_a, b.k AS model_key_b, b.p AS price_b, b.y AS year_b
    FROM pairs JOIN c a ON a.ad_id = x JOIN c b ON b.ad_id = pairs.y
    WHERE NOT (a.dealer AND b.dealer) AND (a.k <> b.k OR coalesce(abs(a.y - b.y) >= 2, false) OR coalesce(abs(a.p - b.p) / greatest(a.p, b.p) > 0.15, false))""")
def photo_pairs_of_different_objects(spark, sf_dir):
    return duplicates.different_objects(photo_exact_pairs(spark, sf_dir), listings(spark, sf_dir))


@query("SELECT l_orderkey AS ad_id, array_to_string(list('http://p/' || l_partkey ORDER BY l_linenumber, 'http://p/' || l_partkey), ' ') AS urls FROM lineitem GROUP BY l_orderkey")
def gallery_list(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ad_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("http://p/"), F.col("l_partkey").cast("string")).alias("url"))
    return duplicates.gallery(rows).select("ad_id", F.array_join("urls", " ").alias("urls"))


# --- observations, statuses, upserts ----------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS last_seq FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    return status.latest_status(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


STATUSES = f"s AS (SELECT user_id, arg_max(CASE WHEN event_id % 5 = 0 THEN 'archived' ELSE 'active' END, event_id) AS st, max(CAST(ts AS DATE)) AS seen, max(CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END) AS checked FROM events GROUP BY user_id)"


def _statuses(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id").agg(F.max_by(F.when(F.col("event_id") % 5 == 0, "archived").otherwise("active"), "event_id").alias("st"), F.max("day").alias("seen"), F.max(F.when(F.col("event_id") % 3 == 0, F.col("day"))).alias("checked"))


@query(f"WITH {STATUSES} SELECT user_id, st <> 'archived' AND date_diff('day', seen, DATE '{AS_OF}') >= 2 AND NOT coalesce(date_diff('day', checked, DATE '{AS_OF}') < 7, false) AS needs_check FROM s")
def status_needs_check(spark, sf_dir):
    days = lambda c: F.datediff(F.lit(AS_OF).cast("date"), c)
    return _statuses(spark, sf_dir).select("user_id", status.needs_check(F.col("st"), days("seen"), days("checked")).alias("needs_check"))


@query(f"WITH {STATUSES} SELECT user_id, st <> 'active' AND (checked IS NULL OR seen > checked) AS inferred FROM s")
def listing_inferred_active(spark, sf_dir):
    return _statuses(spark, sf_dir).select("user_id", status.inferred_active(F.col("st"), F.col("seen"), F.col("checked")).alias("inferred"))


@query("SELECT user_id, CAST(ts AS DATE) AS seen_date, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def daily_sightings_dedup(spark, sf_dir):
    return status.daily_sightings(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")


@query("SELECT event_id, round(lag(value) OVER w, 6) AS previous, round(first_value(value) OVER w, 6) AS first_value, round(value - lag(value) OVER w, 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def price_history(spark, sf_dir):
    out = status.price_history(read(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("previous", "first_value", "change")])


SPLIT = "old AS (SELECT o_orderkey AS k, o_totalprice AS v, nullif(o_orderstatus, 'P') AS s FROM orders WHERE o_orderkey % 4 <> 0), new AS (SELECT o_orderkey AS k, o_totalprice + 1 AS v, o_orderpriority AS s FROM orders WHERE o_orderkey % 3 = 0)"


def _split(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 4 != 0).select(k.alias("k"), F.col("o_totalprice").alias("v"), F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return old, o.where(k % 3 == 0).select(k.alias("k"), (F.col("o_totalprice") + 1).alias("v"), F.col("o_orderpriority").alias("s"))


@query(f"WITH {SPLIT} SELECT k, round(v, 4) AS v, s FROM old UNION ALL SELECT k, round(v, 4), s FROM new WHERE k NOT IN (SELECT k FROM old)")
def upsert_ignore(spark, sf_dir):
    return upserts.upsert_ignore(*_split(spark, sf_dir), ["k"]).withColumn("v", F.round("v", 4))


@query(f"WITH {SPLIT} SELECT coalesce(old.k, new.k) AS k, round(CASE WHEN new.k IS NOT NULL THEN new.v ELSE old.v END, 4) AS v, CASE WHEN old.k IS NULL THEN new.s ELSE old.s END AS s FROM old FULL JOIN new ON old.k = new.k")
def upsert_update(spark, sf_dir):
    return upserts.upsert_update(*_split(spark, sf_dir), ["k"], ["v"]).withColumn("v", F.round("v", 4))


@query(f"WITH {SPLIT} SELECT old.k, round(old.v, 4) AS v, coalesce(old.s, new.s) AS s FROM old LEFT JOIN new ON old.k = new.k")
def fill_if_null(spark, sf_dir):
    return upserts.fill_if_null(*_split(spark, sf_dir), ["k"], ["s"], blank_too=("s",)).withColumn("v", F.round("v", 4))


@query("""WITH old AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_brand END AS b, p_size AS n, 'http://x/' || p_partkey || '-1x1.jpg' AS u FROM part WHERE p_partkey % 5 <> 0),
    new AS (SELECT p_partkey AS k, p_type AS b, 50 - p_size AS n, 'http://x/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '-full.jpg' ELSE '-2x2.jpg' END AS u FROM part WHERE p_partkey % 4 <> 0)
    SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.k IS NULL THEN new.b WHEN old.b IS NULL OR old.b = '' THEN coalesce(new.b, old.b) ELSE old.b END AS b,
        CASE WHEN old.k IS NULL THEN new.n ELSE greatest(old.n, new.n) END AS n, CASE WHEN old.k IS NULL OR coalesce(contains(new.u, '-full.'), false) THEN new.u ELSE old.u END AS u FROM old FULL JOIN new ON old.k = new.k""")
def passport_upgrade(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    url = lambda tail: F.concat(F.lit("http://x/"), k.cast("string"), tail)
    old = p.where(k % 5 != 0).select(k.alias("k"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_brand")).alias("b"), F.col("p_size").alias("n"), url(F.lit("-1x1.jpg")).alias("u"))
    new = p.where(k % 4 != 0).select(k.alias("k"), F.col("p_type").alias("b"), (50 - F.col("p_size")).alias("n"), url(F.when(k % 2 == 0, "-full.jpg").otherwise("-2x2.jpg")).alias("u"))
    return upserts.upgrade_passport(old, new, "k", ["b"], "n", "u").drop("changed")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events) ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def done_set_queue(spark, sf_dir):
    done = read(spark, sf_dir, "events").select(F.col("user_id").alias("p_partkey"))
    return upserts.work_queue(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), done, "p_partkey", 20, F.desc("p_retailprice"))


@query("SELECT conv_id, min(turn) AS first_seq, arg_max(role, turn) FILTER (WHERE trim(coalesce(nullif(role, 'assistant'), '')) <> '') AS role, arg_max(text, turn) FILTER (WHERE trim(coalesce(nullif(role, 'assistant'), '')) <> '') AS text FROM conversations GROUP BY conv_id")
def journal_collapse(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("role", F.nullif("role", F.lit("assistant")))
    return upserts.collapse_journal(rows, ["conv_id"], "turn", "role", "text")


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def journal_last_row(spark, sf_dir):
    return upserts.keep_last(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn").select("conv_id", "role", "turn")


@query(f"SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS used FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') BETWEEN 0 AND 6 GROUP BY 1, 2")
def day_ledger(spark, sf_dir):
    return status.day_ledger(read(spark, sf_dir, "events"), "ts", "event_type", F.lit(1), 7, F.lit("2024-01-30").cast("date"))


@query("""SELECT (SELECT count(DISTINCT user_id) FROM events) AS seen, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events)) AS unseen_gap,
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS label_gap, (SELECT count(*) FROM labels WHERE toxic = 1) AS flagged""")
def gap_counts(spark, sf_dir):
    e, p, d, l = (read(spark, sf_dir, t) for t in ("events", "part", "documents", "labels"))
    counts = [
        e.agg(F.countDistinct("user_id").alias("seen")),
        p.join(e.select(F.col("user_id").alias("p_partkey")).distinct(), "p_partkey", "left_anti").agg(F.count(F.lit(1)).alias("unseen_gap")),
        d.select("doc_id").join(l.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("label_gap")),
        l.agg(F.count_if(F.col("toxic") == 1).alias("flagged")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE text IS NOT NULL AND length(text) >= 500) AS full_text, count(*) FILTER (WHERE length(text) < 500) AS stub, count(toxic) AS verdicts FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def coverage(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n")).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("n") >= 500).alias("full_text"), F.count_if(F.col("n") < 500).alias("stub"), F.count("toxic").alias("verdicts")).withColumnRenamed("c", "n")


# --- review -----------------------------------------------------------------------------------------------------

LABELLED = "j AS (SELECT doc_id, toxic = 1 AS fraud, n_chars > 2500 OR contains(text, 'idiot') AS flagged, concat_ws('|', CASE WHEN n_chars > 2500 THEN 'long' END, CASE WHEN contains(text, 'idiot') THEN 'word' END) AS reasons, CASE WHEN quality = 1 THEN 300 ELSE 60 END AS pop, CASE WHEN quality = 1 THEN 100 ELSE 50 END AS smp FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, sf_dir):
    word = F.contains("text", F.lit("idiot"))
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", (F.col("toxic") == 1).alias("fraud"), ((F.col("n_chars") > 2500) | word).alias("flagged"), rules.joined_reasons(F.when(F.col("n_chars") > 2500, "long"), F.when(word, "word")).alias("reasons"), F.when(F.col("quality") == 1, 300).otherwise(60).alias("pop"), F.when(F.col("quality") == 1, 100).otherwise(50).alias("smp"))


CELLS = "count(*) FILTER (WHERE flagged AND fraud) AS tp, count(*) FILTER (WHERE flagged AND NOT fraud) AS fp, count(*) FILTER (WHERE NOT flagged AND fraud) AS fn, count(*) FILTER (WHERE NOT flagged AND NOT fraud) AS tn"


@query(f"WITH {LABELLED} SELECT {CELLS} FROM j")
def confusion(spark, sf_dir):
    return review.confusion(_labelled(spark, sf_dir), F.col("flagged"), F.col("fraud"))


@query(f"WITH {LABELLED}, w AS (SELECT *, pop / CAST(smp AS DOUBLE) AS w FROM j) SELECT " + ", ".join(f"round(coalesce(sum(w) FILTER (WHERE {c}), 0), 6) AS {n}" for n, c in (("tp", "flagged AND fraud"), ("fp", "flagged AND NOT fraud"), ("fn", "NOT flagged AND fraud"), ("tn", "NOT flagged AND NOT fraud"))) + " FROM w")
def weighted_confusion(spark, sf_dir):
    c = F.col
    out = review.weighted_confusion(_labelled(spark, sf_dir), c("flagged"), c("fraud"), c("pop"), c("smp"))
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


@query(f"WITH {LABELLED}, c AS (SELECT {CELLS} FROM j) SELECT tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def prf(spark, sf_dir):
    out = review.precision_recall(confusion(spark, sf_dir))
    return out.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(f"WITH {LABELLED} SELECT reason, count(*) AS n, round(avg(CAST(fraud AS DOUBLE)), 6) AS precision FROM (SELECT unnest(string_split(reasons, '|')) AS reason, fraud FROM j WHERE reasons <> '') GROUP BY reason")
def rule_precision(spark, sf_dir):
    return review.rule_precision(_labelled(spark, sf_dir), F.col("reasons"), F.col("fraud")).withColumn("precision", F.round("precision", 6))


@query(f"""{FENCED}, st AS (SELECT ad_id, CASE WHEN price_z < -3.5 THEN 'rule_positive' WHEN log_price < lo OR price_z < -2 THEN 'residual_candidate' ELSE 'random_control' END AS sampling_stratum FROM fenced),
    pop AS (SELECT sampling_stratum, count(*) AS stratum_population FROM st GROUP BY 1), o AS (SELECT * FROM st WHERE ad_id NOT IN (SELECT doc_id FROM labels)),
    queue AS (SELECT * FROM o WHERE sampling_stratum <> 'random_control' UNION ALL SELECT * FROM (SELECT * FROM o WHERE sampling_stratum = 'random_control' ORDER BY md5(CAST(ad_id AS VARCHAR)), ad_id LIMIT 50))
    SELECT ad_id, sampling_stratum, stratum_population, count(*) OVER (PARTITION BY sampling_stratum) AS stratum_sample_size FROM queue JOIN pop USING (sampling_stratum)""")
def label_queue_strata(spark, sf_dir):
    rows = _fenced(spark, sf_dir)
    verdicts = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ad_id"))
    z = F.col("price_z")
    return review.labelling_queue(rows, verdicts, "ad_id", z < -CFG.z_threshold, (F.col("iqr_flag") == "low") | (z < -2)).select("ad_id", "sampling_stratum", "stratum_population", "stratum_sample_size")


@query("SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM labels ORDER BY h, doc_id LIMIT 50")
def hash_sample(spark, sf_dir):
    return outliers.hash_sample(read(spark, sf_dir, "labels"), 50, "doc_id").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))


# --- prices -----------------------------------------------------------------------------------------------------

FOLD = "CAST(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % 5 AS INTEGER)"
FOLDED = f"""WITH {PRICED}, f AS (SELECT *, {FOLD.format(x="model_key || '#' || age")} AS fold FROM priced), n AS (SELECT unnest(range(0, 5)) AS g),
    t1 AS (SELECT g, model_key AS k, age_bucket AS a, {{stat}} AS s FROM f, n WHERE fold <> g GROUP BY ALL), t2 AS (SELECT g, model_key AS k, {{stat}} AS s FROM f, n WHERE fold <> g GROUP BY ALL),
    t3 AS (SELECT g, brand AS k, {{stat}} AS s FROM f, n WHERE fold <> g GROUP BY ALL), t4 AS (SELECT g, {{stat}} AS s FROM f, n WHERE fold <> g GROUP BY ALL),
    pred AS (SELECT f.*, coalesce(t1.s, t2.s, t3.s, t4.s) AS predicted FROM f LEFT JOIN t1 ON t1.g = fold AND t1.k = model_key AND t1.a IS NOT DISTINCT FROM age_bucket
        LEFT JOIN t2 ON t2.g = fold AND t2.k = model_key LEFT JOIN t3 ON t3.g = fold AND t3.k = brand LEFT JOIN t4 ON t4.g = fold)"""
MEDIANS, TENTHS = FOLDED.format(stat="median(log_price)"), FOLDED.format(stat="quantile_cont(log_price, 0.1)")
PRICE_TIERS = [["model_key", "age_bucket"], ["model_key"], ["brand"]]
CUTS = (1000.0, 1300.0, 1600.0)


def _folded(spark, sf_dir, stat=0.5):
    rows = pricing.with_fold(priced(spark, sf_dir), F.concat("model_key", F.lit("#"), F.col("age").cast("string")), 5)
    return pricing.hierarchical(rows, "log_price", PRICE_TIERS, [0, 1, 2, 3, 4], stat)


@query(f"{MEDIANS} SELECT ad_id, fold, round(predicted, 6) AS predicted FROM pred")
def baseline_hier_median(spark, sf_dir):
    return _folded(spark, sf_dir).select("ad_id", "fold", F.round("predicted", 6).alias("predicted"))


@query(f"{MEDIANS} SELECT count(*) AS n, round(avg(abs(price - exp(predicted)) / price), 6) AS mape, round(avg(abs(price - exp(predicted))), 4) AS mae, round(1 - sum((log_price - predicted) ** 2) / (sum(log_price * log_price) - sum(log_price) * sum(log_price) / count(*)), 5) AS r2_log FROM pred")
def regression_metrics(spark, sf_dir):
    out = pricing.regression_metrics(_folded(spark, sf_dir), F.col("price"), F.exp("predicted"))
    return out.select("n", F.round("mape", 6).alias("mape"), F.round("mae", 4).alias("mae"), F.round("r2_log", 5).alias("r2_log"))


@query(f"{MEDIANS}, s AS (SELECT CASE WHEN price <= 1000 THEN 's1' WHEN price <= 1300 THEN 's2' WHEN price <= 1600 THEN 's3' ELSE 's4' END AS segment, abs(price - exp(predicted)) / price AS e FROM pred) SELECT segment, count(e) AS n, round(avg(e), 6) AS mape FROM (SELECT unnest(['s1', 's2', 's3', 's4']) AS segment) LEFT JOIN s USING (segment) GROUP BY segment")
def segment_metrics(spark, sf_dir):
    return pricing.segment_metrics(_folded(spark, sf_dir), F.col("price"), F.exp("predicted"), CUTS).withColumn("mape", F.round("mape", 6))


FLOOR = f"""{TENTHS}, off AS (SELECT quantile_disc(log_price - predicted, 0.1) AS o FROM pred), sup AS (SELECT model_key, count(*) AS support FROM priced GROUP BY 1),
    fl AS (SELECT pred.*, predicted + o AS floor_log, coalesce(support, 0) AS support FROM pred LEFT JOIN sup USING (model_key) CROSS JOIN off)"""


def _floored(spark, sf_dir):
    rows = priced(spark, sf_dir)
    return pricing.below_floor(pricing.with_support(pricing.calibrated_floor(_folded(spark, sf_dir, 0.1), "log_price", "predicted"), rows, ["model_key"]))


@query(f"{FLOOR} SELECT ad_id, round(floor_log, 6) AS floor_log, support FROM fl")
def floor_calibrated(spark, sf_dir):
    return _floored(spark, sf_dir).select("ad_id", F.round("floor_log", 6).alias("floor_log"), "support")


@query(f"{FLOOR} SELECT ad_id, round(floor_log - log_price, 6) AS gap FROM fl WHERE floor_log - log_price > 1e-9 AND support >= 8 AND age <= 10 ORDER BY gap DESC, ad_id LIMIT 12")
def below_floor(spark, sf_dir):
    return _floored(spark, sf_dir).where(F.col("is_below") & (F.col("gap") > 1e-9)).select("ad_id", F.round("gap", 6).alias("gap")).orderBy(F.desc("gap"), "ad_id").limit(12)


@query(f"SELECT doc_id, {FOLD.format(x='sha256(lang || source)')} AS fold FROM documents")
def group_folds(spark, sf_dir):
    return pricing.with_fold(read(spark, sf_dir, "documents"), F.sha2(F.concat("lang", "source"), 256), 5).select("doc_id", "fold")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) > floor(count(*) OVER () * 0.8) AS t FROM orders WHERE o_orderdate IS NOT NULL)
    SELECT o_orderkey, CASE WHEN t THEN 'test' WHEN o_custkey NOT IN (SELECT o_custkey FROM r WHERE t) THEN 'train' END AS part FROM r""")
def temporal_holdout(spark, sf_dir):
    return pricing.temporal_holdout(read(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", "o_custkey").select("o_orderkey", "part")


@query("""WITH d AS (SELECT o_orderkey, o_totalprice AS p, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice)
    SELECT count(*) AS n, round(avg(days), 4) AS mean_days, min(days) AS least, max(days) AS most, round(median(days), 4) AS median_days, round(corr(days, p), 5) AS corr_price FROM d WHERE days >= 0""")
def time_to_sell(spark, sf_dir):
    closed = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed_at"))
    rows = pricing.time_to_sell(closed.join(read(spark, sf_dir, "orders"), "o_orderkey"), "closed_at", "o_orderdate")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("days"), 4).alias("mean_days"), F.min("days").alias("least"), F.max("days").alias("most"), F.round(F.median("days"), 4).alias("median_days"), F.round(F.corr("days", "o_totalprice"), 5).alias("corr_price"))


@query("SELECT floor((log10(p_retailprice) - 2.9) / 0.4 * 40) + 1 AS bin, count(*) AS n FROM part WHERE log10(p_retailprice) >= 2.9 AND log10(p_retailprice) < 3.3 GROUP BY 1")
def log_histogram(spark, sf_dir):
    out = sinks.log_histogram(read(spark, sf_dir, "part"), F.col("p_retailprice"), 2.9, 3.3, 40)
    return out.select(F.col("bin").cast("double").alias("bin"), "n")


@query("SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws(chr(31), CAST(p_partkey AS VARCHAR), p_name, p_brand)), 1, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM part")
def fingerprint(spark, sf_dir):
    return sinks.fingerprint(read(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand"])


@query()
def price_gbt_oof(spark, sf_dir):
    """Boosted trees, out of fold over duplicate groups."""
    rows = pricing.with_fold(priced(spark, sf_dir), F.col("model_key"), 2).withColumn("age", F.col("age").cast("double"))
    pipe = pricing.price_pipeline(["age"], ["brand", "model"], "log_price", max_depth=3, max_iter=5)
    return pricing.out_of_fold(pricing.dealt(rows, "ad_id"), pipe, 2, ["ad_id", "log_price"]).withColumn("predicted", F.round("predicted", 6))


ORDERED = """h AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, ln(o_totalprice) AS y, md5('0#' || CAST(o_orderkey AS VARCHAR)) AS h FROM orders)"""


@query(f"""WITH {ORDERED}, p AS (SELECT avg(y) AS prior FROM h) SELECT o_orderkey, round((coalesce(sum(y) OVER a, 0) + prior) / (count(y) OVER a + 1), 6) AS o_orderpriority_stat, round((coalesce(sum(y) OVER b, 0) + prior) / (count(y) OVER b + 1), 6) AS o_orderstatus_stat FROM h, p
    WINDOW a AS (PARTITION BY o_orderpriority ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY o_orderstatus ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def ordered_target_stats(spark, sf_dir):
    """Two categories of few values, each of which holds a third of the rows or so."""
    rows = read(spark, sf_dir, "orders").withColumn("y", F.ln("o_totalprice"))
    for c in ("o_orderpriority", "o_orderstatus"):
        rows = encoding.ordered_statistics(rows, c, "y", "o_orderkey", f"{c}_stat")
    return rows.select("o_orderkey", *[F.round(f"{c}_stat", 6).alias(f"{c}_stat") for c in ("o_orderpriority", "o_orderstatus")])


ORDER_FEATURES = ["n_lines", "quantity", "discount", "month"]


@query()
def quantile_floor(spark, sf_dir):
    """The calibrated floor of each order by boosted trees for the lower tenth, out of fold over customers."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    rows = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumns({"y": F.ln("o_totalprice"), "month": F.month("o_orderdate")})
    rows = working.written(pricing.with_fold(rows, F.col("o_custkey"), CFG.folds).select("o_orderkey", "fold", "y", *ORDER_FEATURES, "o_orderpriority", "o_orderstatus"))
    scored = folded.out_of_fold(rows, "o_orderkey", ORDER_FEATURES, ["o_orderpriority", "o_orderstatus"], "y", CFG.folds, quantile=CFG.floor_alpha, trees=20)
    scored = working.written(scored.withColumnRenamed("model", "fold"))
    return pricing.calibrated_floor(scored, "y", "predicted").select("o_orderkey", "fold", F.round("floor_log", 6).alias("floor_log"), (F.col("y") < F.col("floor_log")).alias("is_below"))


def _features(spark, sf_dir):
    """The thirteen features of a price model, a log price, and a fold over groups of listings of one object."""
    key = F.col("ad_id")
    rows = listings(spark, sf_dir).where("price_tenge is not null").withColumns({
        "log_price": F.ln("price_tenge"), "engine_volume": (1 + key % 20 / 5).cast("double"), "photos_count": key % 30, "is_mileage_missing": F.col("mileage_km").isNull().cast("int"),
        "is_vip": F.coalesce(F.contains("labels", F.lit("VIP")), F.lit(False)).cast("int"), "has_monthly_price": (key % 5 == 0).cast("int"),
        "engine_type": F.when(key % 3 == 0, "дизель").otherwise("бензин"), "transmission": F.when(key % 2 == 0, "автомат").otherwise("механика"), "body_type": F.concat(F.lit("body"), (key % 5).cast("string")),
    })
    rows = rows.withColumn("object", S.duplicate_group(key, [F.col("brand"), F.col("model"), F.col("age")], F.col("description")))
    return pricing.with_fold(rows, F.col("object"), CFG.folds)


def _boosted_prices(spark, sf_dir):
    rows = _features(spark, sf_dir)
    known = encoding.for_each_fold(rows, list(pricing.CATEGORICAL), "log_price", "ad_id", CFG.folds)
    pricing.check_features([*pricing.NUMERIC, *pricing.CATEGORICAL])
    scored = boosting.out_of_fold(known, "ad_id", [*pricing.NUMERIC, *[f"{c}_stat" for c in pricing.CATEGORICAL]], "log_price", CFG.folds)
    return rows, scored


@query()
def price_model_metrics(spark, sf_dir):
    """n, mape, mae and r2 of logs in each fold (null: all), for the boosted trees and for the median of the finest group."""
    rows, scored = _boosted_prices(spark, sf_dir)
    model = working.written(rows.select("ad_id", "log_price").join(scored, "ad_id"))
    tiers = working.written(pricing.hierarchical(rows.withColumns({"model_key": S.model_key(F.col("brand"), F.col("model")), "age_bucket": S.age_bucket(F.col("age"))}), "log_price", PRICE_TIERS, list(range(CFG.folds))))
    return evaluation.fold_metrics({"model": model, "baseline": tiers}, F.exp("log_price"), F.exp("predicted")).select("method", "fold", "n", *[F.round(c, 6).alias(c) for c in ("mape", "mae", "r2_log")])


@query()
def learning_curve(spark, sf_dir):
    """n and mape of the price model at four shares of the groups of listings, with its thirteen features and folds; ten trees of a larger step."""
    curve = evaluation.learning_curve(_features(spark, sf_dir), "ad_id", "object", list(pricing.NUMERIC), list(pricing.CATEGORICAL), "log_price", CFG.folds, trees=10, rate=0.3)
    return curve.withColumn("mape", F.round("mape", 6))


@query()
def iforest_review(spark, sf_dir):
    return forest.isolation_scores(read(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])


# --- scalars and texts ------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST((l_partkey % 10) * 111111 AS BIGINT) AS m, length(CAST((l_partkey % 10) * 111111 AS VARCHAR)) >= 5 AND (l_partkey % 10) * 111111 > 300000 AS is_junk FROM lineitem")
def junk_mileage(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") % 10) * 111_111).alias("m"))
    return rows.withColumn("is_junk", S.is_junk_mileage(F.col("m")))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity * 1400, 0) AS x, l_partkey % 400 AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN x < 0.6 THEN 'far below' WHEN x < 0.85 THEN 'below' WHEN x < 1.15 THEN 'market' WHEN x < 1.4 THEN 'above' WHEN x IS NOT NULL THEN 'far above' END AS band,
        CASE WHEN n <= 100 THEN 'green' WHEN n <= 200 THEN 'yellow' WHEN n <= 270 THEN 'orange' ELSE 'red' END AS zone FROM r""")
def price_bands(spark, sf_dir):
    ratio = F.col("l_extendedprice") / F.nullif(F.col("l_quantity") * 1400, F.lit(0.0))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.price_band(ratio).alias("band"), S.risk_zone(F.col("l_partkey") % 400).alias("zone"))


@query("""WITH r AS (SELECT event_id, user_id % 7 AS before, event_id % 7 AS after, event_id % 5 = 0 AS failed, event_id % 11 = 0 AS limited FROM events)
    SELECT event_id, CASE WHEN after <= 0 THEN 'done' WHEN limited THEN 'rate_limited' WHEN failed THEN 'breaker' WHEN after >= before THEN 'stuck' ELSE 'continue' END AS action,
        before * 30 + least(20, after) <= 200 AND before + least(20, after) <= 10 AS admitted FROM r""")
def next_action(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("b"), (F.col("event_id") % 7).alias("a"), (F.col("event_id") % 5 == 0).alias("f"), (F.col("event_id") % 11 == 0).alias("l"))
    c = F.col
    return rows.select("event_id", S.next_action(c("b"), c("a"), c("f"), c("l")).alias("action"), S.within_budget(c("b") * 30, c("b"), c("a"), F.lit(20), F.lit(200), F.lit(10)).alias("admitted"))


WORDS = ["idiot", "trash", "scum"]


@query("""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, array_to_string(list_filter(['idiot', 'scum', 'trash'], lambda w: contains(t, w)), '|') AS hits FROM t""")
def lexicon_hits(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.lexicon_hits(F.col("text"), WORDS, negations=[], negated_after=None), "|").alias("hits"))


@query("""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
    SELECT doc_id, length(t) AS txt_len, CAST(regexp_matches(t, 'tion|ment') AS INTEGER) + CAST(regexp_matches(t, 'heit') AS INTEGER) AS txt_opt_count, CAST(contains(t, 'idiot') OR contains(t, 'trash') OR contains(t, 'scum') AS INTEGER) AS txt_damage,
        CAST(regexp_matches(t, 'licen[cs]ed') AS INTEGER) AS txt_positive, CAST(contains(t, 'worthless') AS INTEGER) AS txt_urgency FROM t""")
def text_features(spark, sf_dir):
    f = X.text_features(F.col("text"), options=["tion|ment", "heit"], positive="licen[cs]ed", urgent="worthless", damage=WORDS)
    return read(spark, sf_dir, "documents").select("doc_id", f.alias("f")).select("doc_id", "f.*")


@query("""WITH s AS (SELECT p_partkey, p_brand || ' ' || p_type AS title, p_size FROM part)
    SELECT p_partkey, split_part(title, ' ', 1) AS brand, nullif(trim(substr(title, strpos(title, ' ') + 1)), '') AS model, 2027 - p_size AS year, p_size * 1000 AS mileage_km, CAST(p_size AS DOUBLE) / 10 AS engine_volume, 'бензин' AS engine_type, 'автомат' AS transmission, 'седан' AS body_type,
        CASE WHEN p_size % 2 = 0 THEN 'б/у' ELSE 'новый' END AS condition, 'цвет ' || p_size AS description FROM s""")
def spec_line_parse(spark, sf_dir):
    n = F.col("p_size")
    line = F.concat((2027 - n).cast("string"), F.when(n % 2 == 0, " г., б/у").otherwise(" г., новый"), F.lit(" седан, "), (n / 10).cast("string"), F.lit(" л, бензин, КПП автомат, с пробегом "), n.cast("string"), F.lit(" 000 км, цвет "), n.cast("string"))
    rows = read(spark, sf_dir, "part").select("p_partkey", X.brand_model(F.concat_ws(" ", "p_brand", "p_type")).alias("b"), X.spec_line(line).alias("s"))
    return rows.select("p_partkey", "b.*", "s.*")


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title, regexp_replace(url, '\\?.*', '') AS address, false AS is_blocked FROM pages""")
def html_extract(spark, sf_dir):
    html = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", X.squeeze(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("title"), X.without_query(F.col("url")).alias("address"), X.is_blocked(html).alias("is_blocked"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""SELECT page_id, TRY_CAST(nullif(regexp_replace(url, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits, CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(page_id AS INTEGER) END AS n FROM pages""")
def int_coerce(spark, sf_dir):
    raw = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.concat(F.col("page_id").cast("string"), F.lit(".0"))).otherwise(F.col("page_id").cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", X.clean_int(F.col("url")).alias("digits"), X.int_of(raw).alias("n"))


# --- evaluation and queues --------------------------------------------------------------------------------------


@query(f"WITH {LABELLED} SELECT count(*) AS n, count(*) FILTER (WHERE reasons <> '') AS n_suspicious, round(avg(CASE WHEN reasons <> '' THEN 1.0 ELSE 0.0 END), 6) AS share FROM j")
def suspicion_share(spark, sf_dir):
    return evaluation.suspicion_share(_labelled(spark, sf_dir), F.col("reasons")).withColumn("share", F.round("share", 6))


@query(f"WITH l AS ({LISTING}) SELECT ad_id, CASE WHEN mileage_km NOT IN (333333, 444444, 555555, 666666, 777777, 888888, 999999) THEN mileage_km END AS mileage_km, round(ln(price_tenge), 6) AS log_price FROM l WHERE price_tenge > 0 AND ad_id % 9 <> 0")
def training_rows(spark, sf_dir):
    return evaluation.training_rows(listings(spark, sf_dir), F.col("ad_id") % 9 == 0).select("ad_id", "mileage_km", F.round("log_price", 6).alias("log_price"))


@query(f"{MEDIANS} SELECT age_bucket, count(*) AS n, round(avg(abs(price - exp(predicted)) / price), 6) AS mape FROM pred GROUP BY age_bucket")
def error_by_age(spark, sf_dir):
    return evaluation.error_by(_folded(spark, sf_dir), "age_bucket", F.col("price"), F.exp("predicted")).withColumn("mape", F.round("mape", 6))


@query(f"{FLOOR} SELECT count(*) AS n, round(avg(CASE WHEN log_price < floor_log - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS share FROM fl")
def share_below_floor(spark, sf_dir):
    return evaluation.share_below(_floored(spark, sf_dir), F.col("log_price"), F.col("floor_log") - 1e-9).withColumn("share", F.round("share", 6))


ALL_FLOORS = (
    TENTHS.replace("f AS (SELECT *, CAST(", "f AS (SELECT *, ad_id % 9 = 0 AS sus, CASE WHEN ad_id % 9 = 0 THEN -1 ELSE CAST(")
    .replace(" AS fold FROM priced", " END AS fold FROM priced")
    .replace("range(0, 5)", "range(-1, 5)")
    .replace("FROM f, n WHERE fold <> g", "FROM f, n WHERE NOT sus AND fold <> g")
)


@query(f"{ALL_FLOORS}, off AS (SELECT quantile_disc(log_price - predicted, 0.1) AS o FROM pred WHERE NOT sus) SELECT ad_id, round(predicted + o, 6) AS floor_log FROM pred CROSS JOIN off")
def floor_for_all(spark, sf_dir):
    rows = pricing.with_fold(priced(spark, sf_dir), F.concat("model_key", F.lit("#"), F.col("age").cast("string")), 5)
    return evaluation.floor_for_all(rows, "log_price", PRICE_TIERS, F.col("ad_id") % 9 == 0, 5, 0.1).select("ad_id", F.round("floor_log", 6).alias("floor_log"))


@query(f"WITH {STATUSES} SELECT user_id, CAST(date_diff('day', seen, DATE '{AS_OF}') AS INTEGER) AS seen_days FROM s WHERE st <> 'archived' AND date_diff('day', seen, DATE '{AS_OF}') >= 2 AND NOT coalesce(date_diff('day', checked, DATE '{AS_OF}') < 7, false) ORDER BY seen_days DESC, user_id DESC LIMIT 40")
def stalest_first(spark, sf_dir):
    days = lambda c: F.datediff(F.lit(AS_OF).cast("date"), c)
    return queues.stalest_first(_statuses(spark, sf_dir), F.col("st"), days("seen"), days("checked"), "user_id", 40).select("user_id", days("seen").alias("seen_days"))


PHOTOS = "photos AS (SELECT l_orderkey AS ad_id, l_linenumber AS position, l_returnflag = 'R' AS flagged, CASE WHEN l_suppkey % 4 = 0 THEN 'http://img.own.example/' WHEN l_suppkey % 4 = 1 THEN 'none:' ELSE 'http://cdn.example/' END || l_partkey AS url FROM lineitem)"


def _photos(spark, sf_dir):
    host = F.when(F.col("l_suppkey") % 4 == 0, "http://img.own.example/").when(F.col("l_suppkey") % 4 == 1, "none:").otherwise("http://cdn.example/")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ad_id"), F.col("l_linenumber").alias("position"), (F.col("l_returnflag") == "R").alias("flagged"), F.concat(host, F.col("l_partkey").cast("string")).alias("url"))


@query(f"WITH {PHOTOS} SELECT ad_id, position, url FROM photos ORDER BY flagged DESC, contains(url, 'own.example/'), position, ad_id, url LIMIT 100")
def download_order(spark, sf_dir):
    return queues.download_order(_photos(spark, sf_dir), F.col("flagged"), r"own[.]example", 100).select("ad_id", "position", "url")


@query(f"{FENCED} SELECT ad_id, CASE WHEN price_z < -3.5 AND log_price < lo THEN 1 ELSE 0 END AS both_detectors_low FROM fenced")
def both_detectors_low(spark, sf_dir):
    rows = _fenced(spark, sf_dir)
    return queues.review_order(queues.with_both_low(rows, outliers.stat_reasons(F.col("price_z")))).select("ad_id", "both_detectors_low")


@query(f"""WITH {PHOTOS}, g AS (SELECT ad_id, string_agg(url, ' ' ORDER BY position, url) AS photos FROM photos WHERE starts_with(url, 'http') GROUP BY ad_id),
    v AS (SELECT doc_id AS ad_id, CASE WHEN toxic = 1 THEN 'fraud' WHEN quality = 1 THEN 'legit' ELSE 'unknown' END AS verdict FROM labels)
    SELECT p_partkey AS ad_id, p_size AS price_z, c_mktsegment AS options_text, coalesce(photos, '') AS photos, nullif(verdict, 'unknown') AS existing_verdict
    FROM part LEFT JOIN customer ON c_custkey = p_partkey LEFT JOIN g ON g.ad_id = p_partkey LEFT JOIN v ON v.ad_id = p_partkey""")
def card_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ad_id"), F.col("p_size").alias("price_z"))
    extras = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ad_id"), F.col("c_mktsegment").alias("options_text"))
    journal = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ad_id"), F.when(F.col("toxic") == 1, "fraud").when(F.col("quality") == 1, "legit").otherwise("unknown").alias("verdict"), F.col("doc_id").alias("seq"))
    return queues.card_rows(rows, extras, _photos(spark, sf_dir), journal).withColumn("photos", F.array_join("photos", " "))


@query("SELECT event_id, CASE WHEN event_id % 4 > 1 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS at FROM events")
def timestamp_coerce(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, "не указано").when(F.col("event_id") % 4 == 1, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return read(spark, sf_dir, "events").select("event_id", F.date_format(S.timestamp_of(raw), "yyyy-MM-dd HH:mm").alias("at"))


@query()
def group_folds_balanced(spark, sf_dir):
    return pricing.balanced_folds(read(spark, sf_dir, "documents"), "source").select("doc_id", "source", "fold")


# --- saved pages, photos, journals ------------------------------------------------------------------------------


def _list_pages(spark, sf_dir):
    """A saved list of two cards for each part."""
    k, lit = F.col("p_partkey"), F.lit
    card = lambda i: F.concat(lit('<div class="a-card js__a-card" data-id="'), i.cast("string"), lit('"><a href="/a/'), i.cast("string"), lit('?q=1"><h5 class="card__title"><b>'), F.col("p_brand"), lit("</b> "), F.col("p_type"), lit('</h5></a><div class="card__price"><div>от <div>'), i.cast("string"), lit('</div></div> 000&nbsp;₸</div><p class="card__description">2020 г., б/у седан, 2 л, бензин, КПП автомат, '), F.col("p_type"), lit(' &amp;lt;</p><span class="card__region">Town '), F.col("p_size").cast("string"), lit('</span><img src="http://p/'), i.cast("string"), lit('-1x2.jpg"><img data-src="http://p/'), i.cast("string"), lit('-3x4.jpg"><img src="http://p/static/b.png"></div>'))
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(F.concat(lit("<html><body>"), card(k * 2), card(k * 2 + 1), lit("</body></html>")).alias("html"))


@query("""SELECT CAST(i AS VARCHAR) AS ad_id, p_brand || ' ' || p_type AS title, p_brand AS brand, p_type AS model, CAST(i * 1000 AS BIGINT) AS price_tenge, 2020 AS year, 'седан' AS body_type, p_type || ' &lt;' AS description, 'Town ' || p_size AS city, 'http://p/' || i || '-full.jpg' AS urls, '/a/' || i AS url
    FROM (SELECT *, unnest([p_partkey * 2, p_partkey * 2 + 1]) AS i FROM part)""")
def list_page_cards(spark, sf_dir):
    out = pages.cards(_list_pages(spark, sf_dir))
    return out.select("ad_id", "title", "brand", "model", "price_tenge", "spec.year", "spec.body_type", "spec.description", "city", F.array_join("urls", " ").alias("urls"), "url")


@query("""SELECT p_partkey AS ad_id, 'полный ' || p_brand AS drive, 'Да' AS customs_cleared, CAST(p_partkey * 1000 AS INTEGER) AS page_mileage_km, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 100 ELSE -1 END AS market_price, CASE WHEN p_partkey % 3 = 0 THEN 'Аварийная Заложена ' || p_size ELSE '-' END AS page_status_badge,
    'да ' || p_name || ' есть ржавчина' AS seller_comment, 'ржавчин' AS damage_keywords, CAST(p_partkey % 5 = 0 AS INTEGER) AS is_archived, 0 AS is_blocked FROM part""")
def listing_page_facts(spark, sf_dir):
    k, lit = F.col("p_partkey"), F.lit
    html = F.concat(
        lit("<dl><dt>Привод</dt><dd>неизвестно</dd><dt>Привод</dt><dd><b>полный</b> "), F.col("p_brand"), lit("</dd><dt>Растаможен в Казахстане</dt><dd>Да</dd><dt>Пробег</dt><dd>"), k.cast("string"), lit("&#160;000 км</dd></dl>"),
        F.when(k % 3 == 0, F.concat(lit('<div class="x offer__parameters-mortgaged"><div>Аварийная</div> Заложена <div>'), F.col("p_size").cast("string"), lit("</div></div><div>after</div>"))).otherwise(""),
        F.when(k % 5 == 0, "<i>в&nbsp;архиве</i>").otherwise(""), lit('<script>{"descriptionText": "\\u0434а<br/>'), F.col("p_name"), lit('\\nесть ржавчина"'),
        F.when(k % 2 == 0, F.concat(lit(', "avgPrice": '), (k * 100).cast("string"))).otherwise(""), lit("}</script>"),
    )
    out = pages.listing_pages(spread(read(spark, sf_dir, "part"), "p_partkey").select(k.alias("ad_id"), html.alias("html")))
    return out.select("ad_id", "drive", "customs_cleared", "page_mileage_km", "market_price", "page_status_badge", "seller_comment", "damage_keywords", "is_archived", "is_blocked")


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'), '(?s)<!.*?>', ' ', 'g'), '<(footer|title|h1|/footer|/title|/h1)>', '{\\1}', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g') AS x, html FROM pages),
    t AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS x FROM p)
    SELECT page_id, trim(regexp_extract(x, '\\{title\\}(.*?)\\{/title\\}', 1)) AS title, trim(regexp_extract(x, '\\{h1\\}(.*?)\\{/h1\\}', 1)) AS h1, trim(regexp_extract(x, '\\{footer\\}(.*?)\\{/footer\\}', 1)) AS footer,
    CAST(length(trim(regexp_replace(regexp_replace(x, '\\{/?(title|h1|footer)\\}', ' ', 'g'), '\\s+', ' ', 'g'))) AS BIGINT) AS text_chars, CAST(len(regexp_extract_all(html, '<a href')) AS INTEGER) AS links, CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '<p>')) AS INTEGER) AS paragraphs FROM t""")
def page_outline(spark, sf_dir):
    return pages.outlines(read(spark, sf_dir, "pages").select("page_id", "html"))


@query("""SELECT l_orderkey AS ad_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY first_line, url) AS INTEGER) AS position, url
    FROM (SELECT l_orderkey, 'http://p/' || (l_partkey % 7) AS url, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2)""")
def numbered_photos(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ad_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("http://p/"), (F.col("l_partkey") % 7).cast("string")).alias("url"))
    return duplicates.numbered_photos(duplicates.gallery(rows))


@query("""WITH v AS (SELECT doc_id AS k, CASE WHEN toxic = 1 THEN 'fraud' WHEN quality = 1 THEN 'legit' ELSE 'nonsense' END AS verdict FROM labels), good AS (SELECT * FROM v WHERE verdict <> 'nonsense'),
    j AS (SELECT conv_id AS k, turn AS seq, role AS verdict, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT k, seq, coalesce(good.verdict, j.verdict) AS verdict FROM j FULL JOIN good USING (k) WHERE good.verdict IS NULL OR coalesce(n, 1) = 1""")
def set_verdicts(spark, sf_dir):
    journal = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("seq"), F.col("role").alias("verdict"))
    fresh = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.lit(1).alias("seq"), F.when(F.col("toxic") == 1, "fraud").when(F.col("quality") == 1, "legit").otherwise("nonsense").alias("verdict"))
    return upserts.set_verdicts(journal, fresh, "k", "seq")


@query("SELECT doc_id, source FROM documents WHERE CAST('0x' || substr(md5('7#' || source), 1, 8) AS BIGINT) < CAST(floor(0.6 * 4294967296) AS BIGINT)")
def sample_groups(spark, sf_dir):
    return pricing.sample_groups(read(spark, sf_dir, "documents"), "source", 0.6, seed=7).select("doc_id", "source")


@query("""WITH t AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 3 = 0 THEN 'short' WHEN p_partkey % 3 = 1 THEN '  A  Description of ' || p_type END AS d FROM part), s AS (SELECT *, lower(trim(regexp_replace(coalesce(d, ''), '\\s+', ' ', 'g'))) AS x FROM t)
    SELECT p_partkey, sha256(concat_ws(chr(31), p_brand, CAST(p_size AS VARCHAR), CASE WHEN length(x) >= 15 THEN x ELSE 'ad:' || p_partkey END)) AS group_key FROM s""")
def duplicate_group(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "short").when(k % 3 == 1, F.concat(F.lit("  A  Description of "), "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", S.duplicate_group(k, [F.col("p_brand"), F.col("p_size")], text).alias("group_key"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29) THEN make_date(2026, CAST(month(o_orderdate) AS INTEGER), CAST(day(o_orderdate) AS INTEGER)) END AS posted, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS seen FROM orders""")
def listing_dates(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("января", "фев.", "марта", "апр.", "мая", "июня", "июл.", "августа", "сен.", "октября", "нояб.", "декабря")])
    at, k = F.col("o_orderdate"), F.col("o_orderkey")
    posted = F.when(k % 5 == 0, "вчера").otherwise(F.concat_ws(" ", F.dayofmonth(at).cast("string"), F.element_at(names, F.month(at))))
    seen = F.when(k % 4 == 0, "nonsense").otherwise(F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T10:00:00")))
    return read(spark, sf_dir, "orders").select("o_orderkey", S.posted_date(posted, 2026).alias("posted"), S.iso_date(seen).alias("seen"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'ржавчин' WHEN 4 THEN 'без коробки|без матора' WHEN 5 THEN 'ржавчин' WHEN 6 THEN 'битая' ELSE '' END AS hits, CASE WHEN p_partkey % 8 IN (0, 4, 5, 6) THEN 1 ELSE 0 END AS damaged FROM part""")
def damage_with_negations(spark, sf_dir):
    k = F.col("p_partkey") % 8
    cases = ["Есть ржавчина на пороге ", "без единой ржавчины ", "нету никаких гнилей ", "вложения не требует ", "без матора, без коробки ", "салон не прокурен, есть ржавчина ", "битая, не крашена ", None]
    said = F.element_at(F.array(*map(F.lit, cases)), (k + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(said, F.col("p_name")).alias("t"))
    return rows.select("p_partkey", F.array_join(X.lexicon_hits(F.col("t"), X.DAMAGE), "|").alias("hits"), X.has_damage(F.col("t")).cast("int").alias("damaged"))


@query("""SELECT p_partkey, trim(replace(format('{:,}', p_partkey * 12345), ',', ' ')) AS money, repeat('█', CAST(round_even(p_size / 50.0 * 24, 0) AS INTEGER)) || repeat('░', 24 - CAST(round_even(p_size / 50.0 * 24, 0) AS INTEGER)) || printf(' %5.1f%%', p_size * 2.0) AS bar, CASE WHEN p_size <= 9 THEN 'готово' ELSE '~' || CAST(ceil((p_size - 9) / 7.0) AS INTEGER) || ' дн. при 7/день' END AS eta, p_brand || '+' || p_type AS parts, '&lt;b class=&quot;x&quot;&gt;' || p_name || ' &amp; &#x27;co&#x27;' AS escaped,
    'http://x/' || p_partkey || '-full.webp' AS whole, 2.0 + 30.0 / (1 + p_size) AS pause, CAST(ceil(p_partkey * 4.0 / 60) AS BIGINT) AS minutes FROM part""")
def report_columns(spark, sf_dir):
    k, lit = F.col("p_partkey"), F.lit
    return read(spark, sf_dir, "part").select(
        "p_partkey", X.money(k * 12345).alias("money"), X.bar(F.col("p_size"), lit(50)).alias("bar"), X.eta_days(F.col("p_size") - 9, lit(7)).alias("eta"), F.array_join(X.reasons_of(F.concat("p_brand", lit("; |"), "p_type", lit(";"))), "+").alias("parts"),
        X.html_escape(F.concat(lit('<b class="x">'), "p_name", lit(" & 'co'"))).alias("escaped"), X.full_size(F.concat(lit("http://x/"), k.cast("string"), lit("-12x34.webp"))).alias("whole"),
        S.mean_pause(lit(1.0), lit(3.0), lit(20.0), lit(40.0), 1 + F.col("p_size")).alias("pause"), S.eta_minutes(k, lit(4.0)).alias("minutes"),
    )


# --- models in time, curves and residuals -----------------------------------------------------------------------

DATED = [["o_orderpriority", "o_orderstatus"], ["o_orderpriority"]]


def _dated(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", F.floor(F.col("o_orderkey") / 3).alias("g"), F.ln("o_totalprice").alias("log_price"))


@query("""WITH o AS (SELECT *, floor(o_orderkey / 3) AS g, ln(o_totalprice) AS y FROM orders WHERE o_orderdate IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) > floor(count(*) OVER () * 0.8) AS t FROM o),
    tr AS (SELECT * FROM r WHERE NOT t AND g NOT IN (SELECT g FROM r WHERE t)), a AS (SELECT o_orderpriority, o_orderstatus, median(y) AS m FROM tr GROUP BY 1, 2), b AS (SELECT o_orderpriority, median(y) AS m FROM tr GROUP BY 1), c AS (SELECT median(y) AS m, count(*) AS k, max(o_orderdate) AS til FROM tr),
    p AS (SELECT r.y, r.o_orderdate, coalesce(a.m, b.m, c.m) AS e, k, til FROM r LEFT JOIN a ON a.o_orderpriority = r.o_orderpriority AND a.o_orderstatus = r.o_orderstatus LEFT JOIN b ON b.o_orderpriority = r.o_orderpriority CROSS JOIN c WHERE t)
    SELECT 'baseline' AS method, max(k) AS train_rows, count(*) AS test_rows, CAST(max(til) AS DATE) AS train_until, CAST(min(o_orderdate) AS DATE) AS test_from, count(*) AS n, round(avg(abs(exp(y) - exp(e)) / exp(y)), 6) AS mape, round(avg(abs(exp(y) - exp(e))), 3) AS mae, round(1 - sum((y - e) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)), 5) AS r2_log FROM p""")
def temporal_baseline(spark, sf_dir):
    out = evaluation.evaluate_temporal(_dated(spark, sf_dir), "o_orderdate", "o_orderkey", "g", "log_price", DATED)
    return out.withColumns({"train_until": F.to_date("train_until"), "test_from": F.to_date("test_from"), "mape": F.round("mape", 6), "mae": F.round("mae", 3), "r2_log": F.round("r2_log", 5)})


@query()
def temporal_model(spark, sf_dir):
    """Boosted trees against the hierarchical median on the newest fifth."""
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("quantity"))
    pipe = pricing.price_pipeline(["quantity"], ["o_orderpriority", "o_orderstatus"], "log_price", max_depth=3, max_iter=5)
    return evaluation.evaluate_temporal(_dated(spark, sf_dir).join(items, "o_orderkey"), "o_orderdate", "o_orderkey", "g", "log_price", DATED, pipe)


@query()
def price_importances(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("age", F.col("age").cast("double"))
    model = pricing.price_pipeline(["age"], ["brand", "model"], "log_price", max_depth=3, max_iter=5).fit(pricing.dealt(rows, "ad_id"))
    return evaluation.importances(model, spark, ["age"], ["brand", "model"])


@query("""WITH c AS (SELECT l_linenumber / 7.0 AS share, avg(l_discount) AS mape FROM lineitem GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY share) AS i, count(*) OVER () AS k FROM c),
    g AS (SELECT max(mape) FILTER (WHERE i = 1) - max(mape) FILTER (WHERE i = 2) AS a, max(mape) FILTER (WHERE i = k - 1) - max(mape) FILTER (WHERE i = k) AS b FROM o) SELECT round(a * 100, 6) AS first_gain, round(b * 100, 6) AS last_gain, abs(b * 100) < 0.5 AS is_plateau FROM g""")
def curve_gains(spark, sf_dir):
    curve = read(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") / 7.0).alias("share")).agg(F.avg("l_discount").alias("mape"))
    return evaluation.curve_gains(curve).withColumns({"first_gain": F.round("first_gain", 6), "last_gain": F.round("last_gain", 6)})


@query(f"""{MEDIANS}, x AS (SELECT log_price - predicted AS x FROM pred), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x), b AS (SELECT least(CAST(floor((x - lo) / ((hi - lo) / 60)) AS INTEGER), 59) AS i, lo, hi FROM x, e)
    SELECT i + 1 AS bin, round(lo + i * ((hi - lo) / 60), 6) AS low, count(*) AS n FROM b GROUP BY i, lo, hi""")
def residual_histogram(spark, sf_dir):
    return evaluation.residual_histogram(_folded(spark, sf_dir), "log_price", "predicted").withColumn("low", F.round("low", 6))


FIRST_PASS = CLEANED.replace("UNCLEARED", "false").replace("MARKET", "CAST(NULL AS DOUBLE)")


@query(f"""WITH first_pass AS (WITH pairs(ad_id_a, ad_id_b) AS (SELECT 0, 0 WHERE false), {FIRST_PASS} SELECT ad_id AS looked FROM cleaned WHERE suspicion_reasons <> ''),
    {BITS.format(n=16)}, pairs AS (SELECT a.ad_id AS ad_id_a, b.ad_id AS ad_id_b FROM hashes a JOIN hashes b ON a.bits = b.bits AND a.ad_id < b.ad_id),
    {CLEANED.replace("UNCLEARED", "ad_id % 3 = 0 AND ad_id IN (SELECT looked FROM first_pass)").replace("MARKET", "CAST(NULL AS DOUBLE)")}
    SELECT ad_id, info_flags, suspicion_reasons, CAST(suspicion_reasons <> '' AS INTEGER) AS is_suspicious, status FROM cleaned""")
def two_pass_clean(spark, sf_dir):
    """Pages are known only of listings that the first pass suspects."""
    raw = listings(spark, sf_dir).drop("age", "color").withColumns({"city": F.lit("A"), "engine_volume": F.lit(2.0)})
    journal = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ad_id"), F.col("doc_id").alias("seq"), F.when(F.col("toxic") == 1, "fraud").otherwise("legit").alias("verdict"))
    seen = status.latest_status(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type").withColumnRenamed("user_id", "ad_id")

    def look(first):
        facts = first.where("is_suspicious = 1").select("ad_id", F.when(F.col("ad_id") % 3 == 0, "Нет").alias("customs_cleared"))
        return facts, photo_exact_pairs(spark, sf_dir)

    return two_passes(raw, journal, seen, look).select("ad_id", "info_flags", "suspicion_reasons", "is_suspicious", "status")


# --- summaries --------------------------------------------------------------------------------------------------


@query(f"""WITH {STATUSES}, {PHOTOS},
    clean AS (SELECT doc_id AS id, n_chars > 2500 AS sus, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE '' END AS full_text, CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END AS stub, CASE doc_id % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'active' WHEN 2 THEN 'deleted' ELSE 'active' END AS state FROM documents),
    c AS (SELECT clean.*, doc_id IS NULL AS pending FROM clean LEFT JOIN (SELECT DISTINCT doc_id FROM labels) ON doc_id = id),
    h AS (SELECT url, CASE WHEN ad_id % 4 = 0 THEN '' ELSE 'f0' END AS phash FROM photos WHERE position = 1),
    j AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'fraud' WHEN quality = 1 THEN 'legit' ELSE 'unsure' END AS v FROM labels)
    SELECT 'pages' AS section, unnest(['total', 'suspicious', 'pending', 'pending_suspicious']) AS counter, unnest([count(*), count(*) FILTER (WHERE sus), count(*) FILTER (WHERE pending), count(*) FILTER (WHERE pending AND sus)]) AS n FROM c
    UNION ALL SELECT 'pages', unnest(['read', 'failed']), unnest([count(*) FILTER (WHERE quality = 1), count(*) FILTER (WHERE quality IS DISTINCT FROM 1)]) FROM labels
    UNION ALL SELECT 'pictures', unnest(['placeholders', 'done', 'pending']), unnest([count(*) FILTER (WHERE url NOT LIKE 'http%'), count(*) FILTER (WHERE url LIKE 'http%' AND url IN (SELECT url FROM h)), count(*) FILTER (WHERE url LIKE 'http%' AND url NOT IN (SELECT url FROM h))]) FROM photos
    UNION ALL SELECT 'pictures', 'unreadable', count(*) FILTER (WHERE phash = '') FROM h
    UNION ALL SELECT 'texts', unnest(['full', 'stub', 'none']), unnest([count(*) FILTER (WHERE full_text <> ''), count(*) FILTER (WHERE full_text = '' AND stub <> ''), count(*) FILTER (WHERE full_text = '' AND stub = '')]) FROM c
    UNION ALL SELECT 'states', state, count(*) FROM c GROUP BY state
    UNION ALL SELECT 'checks', 'pending', count(*) FILTER (WHERE st <> 'archived' AND date_diff('day', seen, DATE '{AS_OF}') >= 2 AND NOT coalesce(date_diff('day', checked, DATE '{AS_OF}') < 7, false)) FROM s
    UNION ALL SELECT 'verdicts', unnest(['fraud', 'legit', 'journal_rows', 'unknown']), unnest([count(*) FILTER (WHERE v = 'fraud'), count(*) FILTER (WHERE v = 'legit'), count(*), count(*) FILTER (WHERE v = 'unsure')]) FROM j""")
def pipeline_progress(spark, sf_dir):
    k = F.col("doc_id")
    state = F.when(k % 5 == 0, "archived").when(k % 5 == 1, None).when(k % 5 == 2, "deleted").otherwise("active")
    clean_rows = read(spark, sf_dir, "documents").select(k.alias("ad_id"), (F.col("n_chars") > 2500).cast("int").alias("is_suspicious"), F.when(k % 3 == 0, F.col("text")).alias("seller_comment"), F.when(k % 2 == 0, F.col("lang")).otherwise("").alias("description"), state.alias("status"))
    labels = read(spark, sf_dir, "labels")
    enriched = labels.select(k.alias("ad_id"), F.when(F.col("quality") == 1, 200).otherwise(404).alias("http_status"))
    journal = labels.select(k.alias("ad_id"), F.when(F.col("toxic") == 1, " Fraud").when(F.col("quality") == 1, "LEGIT").otherwise("unsure").alias("verdict"), k.alias("seq"))
    photos = _photos(spark, sf_dir)
    hashes = photos.where("position = 1").select("url", F.when(F.col("ad_id") % 4 == 0, "").otherwise("f0").alias("phash"))
    days = lambda c: F.datediff(F.lit(AS_OF).cast("date"), c)
    lifecycle = _statuses(spark, sf_dir).select(F.col("st").alias("status"), days("seen").alias("seen_days"), days("checked").alias("checked_days"))
    return summary.progress(clean_rows, enriched, photos, hashes, lifecycle, journal)


@query(f"""{MEDIANS}, d AS (SELECT date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS days, any_value(log_price - predicted) AS r FROM lineitem JOIN pred ON ad_id = l_partkey GROUP BY l_partkey)
    SELECT count(*) AS n, round(avg(days), 5) AS mean, round(stddev_samp(days), 5) AS std, CAST(min(days) AS INTEGER) AS least, CAST(max(days) AS INTEGER) AS most, quantile_cont(days, 0.25) AS q25, quantile_cont(days, 0.5) AS q50, quantile_cont(days, 0.75) AS q75, count(*) FILTER (WHERE r < 0) AS n_below, count(*) FILTER (WHERE r >= 0) AS n_above,
    median(days) FILTER (WHERE r < 0) AS median_below, median(days) FILTER (WHERE r >= 0) AS median_above, round(corr(days, r), 5) AS corr FROM d WHERE days >= 0""")
def selling_times(spark, sf_dir):
    sold = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("ad_id")).agg(F.min("l_shipdate").alias("posted"), F.max("l_shipdate").alias("closed"))
    scored = _folded(spark, sf_dir).select("ad_id", (F.col("log_price") - F.col("predicted")).alias("residual"))
    out = summary.selling_times(pricing.time_to_sell(sold, "closed", "posted").join(scored, "ad_id"))
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "std", "corr")})


@query("""WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
    x AS (SELECT q.*, o_totalprice AS v, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM orders JOIN q ON o_orderpriority = g)
    SELECT g AS o_orderpriority, count(*) AS n, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, min(v) FILTER (WHERE inside) AS whisker_low, max(v) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS n_outside FROM x GROUP BY g, q1, med, q3""")
def price_boxes(spark, sf_dir):
    return summary.boxes(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority").withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE l_quantity * 1400 END AS m FROM lineitem), x AS (SELECT *, p / nullif(m, 0) AS ratio FROM r)
    SELECT l_orderkey, l_linenumber, CASE WHEN m > 0 AND p IS NOT NULL THEN '<b>' || CAST(round_even(ratio * 100, 0) AS BIGINT) || '% от средней цены</b> (' || replace(format('{:,}', CAST(m AS BIGINT)), ',', ' ') || ') — ' ||
        CASE WHEN ratio < 0.6 THEN 'сильно дешевле рынка' WHEN ratio < 0.85 THEN 'заметно ниже среднего' WHEN ratio < 1.15 THEN 'в пределах среднего' WHEN ratio < 1.4 THEN 'выше среднего' ELSE 'существенно выше рынка — приманкой быть не может' END ELSE '' END AS hint FROM x""")
def market_hints(spark, sf_dir):
    k = F.col("l_partkey") % 4
    market = F.when(k == 0, None).when(k == 1, F.lit(0.0)).otherwise(F.col("l_quantity") * 1400)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", summary.market_hint(F.col("l_extendedprice"), market).alias("hint"))


@query("""WITH c AS (SELECT o_custkey AS ad_id, max(CAST(o_totalprice > 300000 AS INTEGER)) AS s FROM orders GROUP BY 1)
    SELECT c_custkey AS ad_id, coalesce(s, 0) AS is_suspicious FROM customer LEFT JOIN c ON ad_id = c_custkey""")
def queue_suspicion(spark, sf_dir):
    flagged = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ad_id"), (F.col("o_totalprice") > 300000).alias("is_suspicious"))
    return summary.with_suspicion(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ad_id")), flagged)


@query("SELECT p_partkey, p_name FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 25")
def spotlight_rows(spark, sf_dir):
    return summary.seeded_rows(read(spark, sf_dir, "part").select("p_partkey", "p_name"), 25, "p_partkey", 7)


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS b FROM orders)
    SELECT o_orderkey, round(TRY_CAST(a AS DOUBLE), 4) AS age, coalesce(b, 'NA') AS brand, CAST(NULL AS DOUBLE) AS engine_volume, 'NA' AS condition FROM o""")
def coerced_features(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("age"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("brand"))
    return pricing.coerce_features(rows).select("o_orderkey", F.round("age", 4).alias("age"), "brand", "engine_volume", "condition")
