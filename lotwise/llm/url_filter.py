"""URL filters by a sort-merge range join over reversed-host keys.

A host a.b.c becomes the key "c.b.a.", so a rule for b.c covers the keys in
["c.b.", "c.b/") : its host and every subdomain.  Rules and pages are sorted
together by key; going through them in order, the rules whose interval is still
open form a stack, one entry for each number of labels.  The stack is kept by
running "last rule with d labels" windows.  An entry is open while its key is a
prefix of the current one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
DEFAULT_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """'www.example.net' -> 'net.example.www.'; labels hold no dot, so a key is a prefix of its subdomains' keys only."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), r)]) for r in rules]
    one = spark.range(1)
    if not rows:
        return one.filter("false").select(*[F.lit("").alias(n) for n in ("host", "path", "verdict")])
    return one.select(F.inline(F.array(*rows)))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every page's url: (id, host, path, rule, verdict), a row for each input row.

    `rules` has host, path, verdict.  A rule fits its host and all subdomains if
    the url's path starts with the rule's.  The longest rule (host and path
    together) wins; of equally long ones the one with the longer host, then a
    block.  Without a fitting rule, rule is null and verdict is `default`.  A
    null url, or one without "://", has an empty host and path and fits no rule
    (nor does an empty rule host).  Repeated rows and null ids are judged one by
    one, very long urls like any other; an empty table gives no rows.  Columns
    other than the two named are not read and may have any name.  The rules of one host travel as one
    array, so a single host's rules must fit a row.
    """
    hosts = (
        rules.where("host <> '' and path is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .groupBy("host")
        .agg(F.collect_set(F.struct("path", "verdict")).alias("found"))
        .select(
            reversed_key(F.col("host")).alias("key"),
            F.size(F.split("host", "[.]", -1)).alias("depth"),
            F.expr("transform(found, r -> struct(r.path as path, concat(host, r.path) as rule, length(host) as host_chars, r.verdict as verdict))").alias("rules"),
        )
    )
    judged = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    deepest = hosts.agg(F.max("depth")).first()[0]
    if deepest is None:
        return judged.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = (
        judged.withColumn("key", F.when(F.col("host") != "", reversed_key(F.col("host"))).otherwise(F.lit("")))
        .withColumn("is_page", F.lit(True))
        .unionByName(hosts.withColumn("is_page", F.lit(False)), allowMissingColumns=True)
        .repartitionByRange(n, "key", "is_page", "id")
        .withColumn("part", F.spark_partition_id())
    )
    events = scratch.table(events, "events")
    sweep = events.unionByName(_open_before(events, deepest), allowMissingColumns=True)
    so_far = Window.partitionBy("part").orderBy("key", "is_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = [F.last(F.when((F.col("depth") == d) & ~F.col("is_page"), F.struct("key", "rules")), ignorenulls=True).over(so_far) for d in range(1, deepest + 1)]
    swept = sweep.select("is_page", "id", "host", "path", "key", *[s.alias(f"slot{d}") for d, s in enumerate(stack, 1)]).where("is_page")
    slots = [F.when(F.startswith(F.col("key"), F.col(f"slot{d}.key")), F.col(f"slot{d}.rules")) for d in range(1, deepest + 1)]
    fitting = F.filter(F.flatten(F.array_compact(F.array(*slots))), lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("chars"), r["host_chars"].alias("host_chars"), (r["verdict"] == "block").alias("blocks"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    best = swept.select("id", "host", "path", F.array_max(ranked).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _open_before(events: DataFrame, deepest: int) -> DataFrame:
    """For each range partition, the rules of earlier partitions that are still open at its first key.

    One row for each partition and depth goes through a window, whatever the number of pages.
    """
    parts = events.groupBy("part").agg(F.min("key").alias("first_key")).withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(deepest))))
    last = events.where("not is_page").groupBy("part", "depth").agg(F.max(F.struct("key", "rules")).alias("rule"))
    before = Window.partitionBy("depth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.join(last, ["part", "depth"], "left")
        .select("part", "depth", "first_key", F.last("rule", ignorenulls=True).over(before).alias("rule"))
        .where(F.startswith("first_key", "rule.key"))
        .select("part", "depth", F.col("rule.key").alias("key"), F.col("rule.rules").alias("rules"), F.lit(False).alias("is_page"))
    )
