"""URL filters by host-suffix and path-prefix expressions, in DataFrame operations only.

Each URL is expanded into expressions host-suffix + path-prefix, one for each suffix of the host by labels
and each prefix length that a rule has. Expressions meet rules in an equi-join on the first four bytes of
their SHA-256; the full digests then confirm, and the longest rule decides (block before allow in a tie).

Defined results: a null URL, or one without `://`, has empty host and path and no rule. Repeated rows each
get a result. An empty rule table gives every URL the verdict of `otherwise`. The rules are broadcast only
if they are at most BROADCAST_RULES rows, else the join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Columns key, host, path, rule and verdict for each row of pages."""
    rules = rules.select(
        "verdict",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.length("rule_path").alias("_n"),
        F.sha2(_expression(F.col("rule_host"), F.col("rule_path")), 256).alias("_digest"),
    ).withColumn("_short", F.substring("_digest", 1, 8))
    # distinct prefix lengths: bounded by the longest rule path, not by the number of rules
    size = rules.agg(F.count("*").alias("n"), F.collect_set("_n").alias("lengths")).first()
    lengths = F.array(*[F.lit(n) for n in sorted(size["lengths"])]) if size["n"] else F.array().cast("array<int>")
    copies = pages.select(F.col(key), F.col(url).alias("_url")).groupBy(key, "_url").agg(F.count("*").alias("_copies"))
    urls = copies.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    made = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: F.sha2(_expression(h, p), 256))))
    asked = urls.withColumn("_asked", F.explode_outer(F.when(F.col("_url").contains("://"), made)))
    asked = asked.withColumn("_short", F.substring("_asked", 1, 8))
    rules = F.broadcast(rules) if size["n"] <= BROADCAST_RULES else rules
    met = asked.join(rules, "_short", "left")
    fits = F.when(F.col("_asked") == F.col("_digest"), F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict"))
    best = met.groupBy(key, "_url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("_copies").alias("_copies"), F.max(fits).alias("best"))
    each = best.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return each.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
