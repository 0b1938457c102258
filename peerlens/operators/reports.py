"""Counters and small reports over companies, raw reports and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import text as tx

from .quality import section_kind

#: Keys of a query that a snapshot keeps (fixed values).
SNAPSHOT_KEYS = ["name", "one_liner", "categories", "business_model", "country", "founded_year", "team_size", "stage", "main_concern", "secondary_concerns", "notes", "website", "total_funding"]


def counts(df: DataFrame, columns: list[str], k: int = 30) -> DataFrame:
    """column, value, n: the most frequent values of each column, from one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), tx.absent(F.col(c).cast("string")).alias("value")) for c in columns]))
    rows = df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def source_summary(records: DataFrame) -> DataFrame:
    """source, records, entities, shared: rows of a source, its entities, and those that other sources have too."""
    sets = records.groupBy("norm").agg(F.collect_set("source").alias("s"))
    shared = sets.select(F.explode("s").alias("source"), (F.size("s") > 1).alias("more")).groupBy("source").agg(F.count("*").alias("entities"), F.count_if("more").alias("shared"))
    return records.groupBy("source").agg(F.count("*").alias("records")).join(shared, "source")


def section_coverage(reports: DataFrame, sections: list[str], paywall: list[str]) -> DataFrame:
    """section, real, pro_only, weak, empty over the section columns of raw reports."""
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), section_kind(F.col(s), paywall).alias("kind")) for s in sections]))
    rows = reports.select(kinds.alias("k")).select("k.*")
    return rows.groupBy("section").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("real", "pro_only", "weak", "empty")])


def complete_reports(reports: DataFrame, key: str, sections: list[str], paywall: list[str]) -> DataFrame:
    """Keys of the reports all of whose sections are real, and the number of real sections of the others."""
    n = sum((F.when(section_kind(F.col(s), paywall) == "real", 1).otherwise(0) for s in sections), F.lit(0))
    return reports.select(key, n.alias("real_sections"), (n == len(sections)).alias("complete"))


def corpus_meta(companies: DataFrame) -> DataFrame:
    """One row: companies, dead ones, those with a cause, countries."""
    return companies.agg(
        F.count("*").alias("companies"),
        F.count_if(cl.is_dead(F.col("status"))).alias("dead"),
        F.count_if(tx.absent(F.col("cause")).isNotNull()).alias("with_cause"),
        F.countDistinct("country").alias("countries"),
    )


def label_histogram(patterns: DataFrame, k: int = 6) -> DataFrame:
    rows = patterns.select(F.explode("pattern_labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "label").limit(k)


def known_categories(companies: DataFrame, k: int = 40) -> DataFrame:
    rows = companies.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "category").limit(k)


def suggestions(categories: DataFrame, typed: str, chosen: list[str], k: int = 8) -> DataFrame:
    """Categories that contain what was typed and aren't chosen, the most frequent first."""
    rows = categories.where(F.contains(F.lower("category"), F.lit(typed.lower())))
    return (rows.where(~F.col("category").isin(chosen)) if chosen else rows).orderBy(F.desc("n"), "category").limit(k)


def top_causes(matches: DataFrame, top: int = 15, k: int = 4) -> DataFrame:
    """query_id, cause, n: the causes most frequent among a query's best matches."""
    rows = matches.where((F.col("final_rank") <= top) & tx.absent(F.col("cause")).isNotNull()).groupBy("query_id", "cause").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "cause")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def rejected(queries: DataFrame) -> DataFrame:
    """query_id, reasons of queries that lack what a consultation needs."""
    reasons = F.array_compact(
        F.array(
            F.when(tx.absent(F.col("name")).isNull(), "NAME"),
            F.when(F.length(F.trim(F.coalesce("one_liner", F.lit("")))) < 12, "ONE_LINER"),
            F.when(F.coalesce(F.size("categories"), F.lit(0)) < 1, "CATEGORIES"),
            F.when(tx.absent(F.col("main_concern")).isNull(), "MAIN_CONCERN"),
        )
    )
    return queries.select("query_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def snapshot(query: DataFrame, kind: str, taken_at: Column) -> DataFrame:
    """company_id, taken_at, type, input: the kept keys of a query as one struct."""
    keys = [c for c in SNAPSHOT_KEYS if c in query.columns]
    return query.select("company_id", taken_at.alias("taken_at"), F.lit(kind).alias("type"), F.struct(*keys).alias("input"))


def inherited(answers: DataFrame, snapshots: DataFrame, fields: tuple[str, ...] = ("name", "country", "founded_year", "business_model")) -> DataFrame:
    """Follow-up answers with absent fields from the company's last snapshot."""
    last = snapshots.groupBy("company_id").agg(F.max_by("input", "taken_at").alias("_last"))
    joined = answers.join(last, "company_id", "left")
    return joined.withColumns({f: F.coalesce(tx.absent(F.col(f)), F.col(f"_last.{f}")) for f in fields}).drop("_last")


def confidence_counts(matches: DataFrame) -> DataFrame:
    """query_id, high, medium, low: matches by confidence."""
    return matches.groupBy("query_id").agg(*[F.count_if(F.col("confidence").startswith(level)).alias(level) for level in ("high", "medium", "low")])


def source_overlap(records: DataFrame) -> DataFrame:
    """a, b, shared: entities that two sources have in common, each pair once."""
    # sources of an entity are few
    sets = records.groupBy("norm").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def segment_causes(companies: DataFrame, segment: str = "category", k: int = 3) -> DataFrame:
    """segment, cause, n, inferred: the most frequent causes of a segment, and how many of them are inferred."""
    rows = companies.where(tx.absent(F.col("cause")).isNotNull()).groupBy(segment, "cause").agg(F.count("*").alias("n"), F.count_if("cause_inferred").alias("inferred"))
    w = Window.partitionBy(segment).orderBy(F.desc("n"), "cause")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def segment_countries(companies: DataFrame, segment: str = "category", k: int = 3) -> DataFrame:
    """segment, country, n: the most frequent countries of a segment."""
    rows = companies.where(tx.absent(F.col("country")).isNotNull()).groupBy(segment, "country").agg(F.count("*").alias("n"))
    w = Window.partitionBy(segment).orderBy(F.desc("n"), "country")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
