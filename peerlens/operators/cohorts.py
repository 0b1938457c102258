"""Cohort tables, failure patterns, segment statistics and path signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import classify as cl

OUTCOMES = ("operating", "acquired", "dead", "unknown")


def outcome_counts(outcome: str = "outcome") -> list[Column]:
    """Aggregates: rows of each outcome (absent counts as unknown) and in all."""
    o = F.coalesce(F.col(outcome), F.lit("unknown"))
    return [*[F.count_if(o == x).alias(x) for x in OUTCOMES], F.count("*").alias("total")]


def cohort_survival(companies: DataFrame, macros: str = "macros", decade: str = "decade", outcome: str = "outcome") -> DataFrame:
    """Outcomes of each macro and decade, of each macro, and in all, in one pass over grouping sets.

    A company of several macros counts in each, one without macros in `_other`. `level` is 0 for cells, 1
    for macros and 3 for everything (where companies of several macros count as often).
    """
    some = F.when(F.size(macros) > 0, F.col(macros)).otherwise(F.array(F.lit("_other")))
    rows = companies.select(F.explode(some).alias("macro"), F.col(decade).alias("decade"), F.col(outcome).alias("outcome"))
    cells = rows.rollup("macro", "decade").agg(*outcome_counts("outcome"), F.grouping_id().alias("level"))
    return cells.withColumns({"survival_rate": cl.share(F.col("operating") + F.col("acquired"), F.greatest("total", F.lit(1))), "death_rate": cl.share(F.col("dead"), F.greatest("total", F.lit(1)))})


def with_cohort_peers(companies: DataFrame, key: str = "company_id", macros: str = "macros", reach: int = 2) -> DataFrame:
    """Adds peers_co_dying and cohort_size: the most dead companies within `reach` years in any (macro, decade, country) of a company.

    Deaths are counted by year first, so the range frame runs over years and never over companies.
    """
    rows = companies.select(key, "decade", "country", "shutdown_year", F.col("outcome"), F.explode_outer(macros).alias("macro"))
    dead = rows.where("outcome = 'dead' and shutdown_year is not null and macro is not null")
    cell = ["macro", "decade", "country"]
    by_year = dead.groupBy(*cell, "shutdown_year").agg(F.count("*").alias("n"))
    near = F.sum("n").over(Window.partitionBy(*cell).orderBy("shutdown_year").rangeBetween(-reach, reach))
    size = F.sum("n").over(Window.partitionBy(*cell))
    counted = by_year.select(*cell, "shutdown_year", near.alias("near"), size.alias("size"))
    of_company = dead.join(counted, [*cell, "shutdown_year"]).groupBy(key).agg((F.max("near") - 1).alias("peers_co_dying"), F.max("size").alias("cohort_size"))
    return companies.join(of_company, key, "left").withColumns({"peers_co_dying": F.coalesce("peers_co_dying", F.lit(0)), "cohort_size": F.coalesce("cohort_size", F.lit(0))})


def failure_pattern(companies: DataFrame) -> DataFrame:
    """Adds lifespan_years, pattern_labels and pattern_confidence of dead companies.

    Labels: the lifespan's band, solo_founder, scope_drift (four categories or more), acqui_hire (acquired
    within three years) and cohort_collapse (ten peers or more died within two years).
    """
    span = F.col("shutdown_year") - F.col("founded_year")
    span = F.when(span >= 0, span)
    labels = F.array_compact(
        F.array(
            cl.lifespan_band(span),
            F.when(F.size("categories") >= 4, "scope_drift"),
            F.when(F.size("founders") == 1, "solo_founder"),
            F.when((F.col("outcome") == "acquired") & (span < 3), "acqui_hire"),
            F.when(F.col("peers_co_dying") >= 10, "cohort_collapse"),
        )
    )
    known = F.col("lifespan_years").isNotNull()
    return companies.withColumns({"lifespan_years": span, "pattern_labels": labels}).withColumn(
        "pattern_confidence", F.when(F.size("pattern_labels") == 0, None).when(known & (F.size("pattern_labels") >= 3), "high").when(known, "medium").otherwise("low")
    )


def path_signal(top: DataFrame, segment: DataFrame, keys: list[str]) -> DataFrame:
    """direction of each query: share of dead among its closest peers against its segment's share."""
    joined = top.select(*keys, F.col("dead").alias("td"), F.col("total").alias("tn")).join(segment.select(*keys, F.col("dead").alias("sd"), F.col("total").alias("sn")), keys, "full_outer")
    gap = F.col("td") / F.col("tn") - F.col("sd") / F.col("sn")
    direction = (
        F.when(F.coalesce("tn", F.lit(0)) == 0, "SEM_MATCHES")
        .when(F.coalesce("sn", F.lit(0)) == 0, "SEM_SEGMENTO")
        .when(F.col("sn") < 20, "INCERTO")
        .when(gap >= 0.20, "NEGATIVO")
        .when(gap <= -0.15, "POSITIVO")
        .otherwise("NEUTRO")
    )
    return joined.select(*keys, direction.alias("direction"), cl.round4(gap).alias("gap"))


def verdict_code(direction: Column, short_input: Column, top_score: Column) -> Column:
    """Code of the verdict: short input first, then the direction, then the top score's band."""
    return (
        F.when(short_input, "SHORT_INPUT")
        .when(direction.isin("NEGATIVO", "POSITIVO", "NEUTRO", "INCERTO"), direction)
        .when(top_score >= 70, "STRONG")
        .when(top_score >= 50, "MODERATE")
        .when(top_score >= 30, "WEAK")
        .otherwise("NONE")
    )


def segment_trust(peers: Column) -> Column:
    return F.when(peers < 10, 0.5).when(peers < 20, 0.75).otherwise(1.0)


def comparison_decades(cells: DataFrame, least: int = 30) -> DataFrame:
    """Known decades of a macro with enough companies, with the change of the survival rate since the decade before."""
    w = Window.partitionBy("macro").orderBy("decade")
    kept = cells.where((F.col("level") == 0) & (F.col("total") >= least) & (F.col("decade") != "unknown"))
    return kept.withColumn("delta", cl.round4(F.col("survival_rate") - F.lag("survival_rate").over(w))).select("macro", "decade", "total", "survival_rate", "delta")


def top_values(df: DataFrame, column: str, k: int, order: str) -> DataFrame:
    """Most frequent values; ties by first appearance in `order`."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").limit(k).drop("_first")


