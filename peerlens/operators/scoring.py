"""Explainable match scores between queries and companies, reranking by profile and confidence.

Queries are a table, so one or ten thousand consultations take one plan. A query needs the columns query_id,
macros, category_keys, model, country, founded_year, cause, secondary; a company those named below. The dimensions stand
in `dims`, an array of struct<name, value, points>; a dimension that doesn't apply is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import lexicons as lx

W = lx.WEIGHTS


def dimension(name: str, value: Column, weight: Column | float, applies: Column) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.when(applies, F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), (value * w).cast("double").alias("points")))


def overlap(name: str, asked: Column, has: Column, weight: float) -> Column:
    both = F.size(F.array_intersect(asked, has))
    return dimension(name, F.try_divide(both, F.size(asked)), weight, (F.size(asked) > 0) & (both > 0))


def era(asked: Column, has: Column) -> Column:
    """Full value for equal years, none from a gap of four on."""
    gap = F.abs(asked - has)
    return dimension("era", 1 - F.pow(gap / 4.0, F.lit(1.5)), W["era"], gap <= 3)


def country(asked: Column, has: Column) -> Column:
    """Equal names, or one within the other."""
    return dimension("country", F.lit(1.0), W["country"], (asked != "") & (has != "") & (F.contains(asked, has) | F.contains(has, asked)))


def lexical(similarity: Column) -> Column:
    return dimension("lexical", F.least(similarity, F.lit(1.0)), W["lexical"], similarity >= lx.MIN_LEXICAL)


def semantic(similarity: Column, trust: Column | float = 1.0) -> Column:
    t = trust if isinstance(trust, Column) else F.lit(trust)
    return dimension("semantic", semantic_value(similarity), W["semantic"] * t, similarity >= lx.MIN_SEMANTIC)


def semantic_value(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - lx.MIN_SEMANTIC) / 0.48))


def cause(asked: Column, has: Column, inferred: Column, corroborated: Column) -> Column:
    weight = F.when(inferred, W["cause_inferred"]).otherwise(W["cause"]) * F.when(corroborated, 1.0).otherwise(0.6)
    return dimension("cause", F.lit(1.0), weight, (asked != "") & (asked == has))


def secondary(asked: Column, has: Column) -> Column:
    return dimension("secondary", F.lit(1.0), W["secondary"], (has != "") & F.exists(asked, lambda x: x == has))


def total(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(0.0), lambda s, d: s + d["points"])


def strong(dims: Column) -> Column:
    return F.size(F.filter(dims, lambda d: d["value"] >= 0.3))


def with_score(pairs: DataFrame, dims: list[Column], dead: Column) -> DataFrame:
    """Adds dims, convergence (dead, with four strong dimensions or more: a bonus) and score."""
    df = pairs.withColumns({f"_{i}": d for i, d in enumerate(dims)})
    each = [F.col(f"_{i}") for i in range(len(dims))]
    points = sum((F.coalesce(d["points"], F.lit(0.0)) for d in each), F.lit(0.0))
    many = sum((F.coalesce(d["value"] >= 0.3, F.lit(False)).cast("int") for d in each), F.lit(0))
    df = df.withColumn("convergence", dead & (many >= 4))
    df = df.withColumn("score", points + F.when(F.col("convergence"), lx.CONVERGENCE_BONUS).otherwise(0.0))
    return df.withColumn("dims", F.array_compact(F.array(*each))).drop(*[f"_{i}" for i in range(len(dims))])


def ranked(scored: DataFrame, query: str = "query_id", order: str = "company_id", least: float = lx.MIN_SCORE) -> DataFrame:
    """Rows from the least score on, numbered by score; ties in corpus order."""
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), order)
    return scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w))


def profile_similarity(parts: dict[str, Column]) -> Column:
    """Weighted mean of the parts that are known; 0.5 if none is. parts: name -> value in 0..1 or null."""
    weights = lx.PROFILE_WEIGHTS
    above = below = F.lit(0.0)
    for name, value in parts.items():
        above = above + F.coalesce(value * weights[name], F.lit(0.0))
        below = below + F.when(value.isNotNull(), weights[name]).otherwise(0.0)
    return F.coalesce(F.try_divide(above, below), F.lit(0.5))


def nearness(a: Column, b: Column, span: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / span)


def rerank(rows: DataFrame, similarity: str, query: str = "query_id", head: int = 50, blend: float = 0.4) -> DataFrame:
    """The first `head` ranks by score * (1 - blend + blend * similarity); the tail keeps its order behind them."""
    first = F.col("rank") <= head
    new = F.when(first, F.col("score") * (1 - blend + blend * F.col(similarity))).otherwise(F.col("score"))
    rows = rows.withColumn("final_score", new)
    w = Window.partitionBy(query).orderBy(F.when(first, 0).otherwise(1), F.when(first, -F.round("final_score", 9)), "rank")
    return rows.withColumn("final_rank", F.row_number().over(w))


def confidence(score: Column, dims: Column, convergence: Column, short_input: Column, trust: Column | float = 1.0) -> Column:
    """Ladder of confidence, lowered by one where the segment is sparse."""
    names = F.transform(F.filter(dims, lambda d: d["value"] >= 0.3), lambda d: d["name"])
    only_cause = F.size(F.array_except(names, F.array(F.lit("cause"), F.lit("secondary")))) == 0
    n = F.size(names)
    level = (
        F.when(short_input, "low")
        .when(only_cause, "low")
        .when(convergence, "high")
        .when((score >= 55) & (n >= 3), "high")
        .when((score >= 35) & (n >= 2), "medium")
        .otherwise("low")
    )
    t = trust if isinstance(trust, Column) else F.lit(trust)
    return F.when((t < 1.0) & (level == "high"), "medium").otherwise(level)


def input_quality(words: Column, text: Column) -> Column:
    """struct<distinct, trust, short, warnings> of what a query says."""
    n = F.size(F.array_distinct(words))
    warnings = F.array_compact(F.array(F.when(n < 5, "FEW_WORDS"), F.when(F.length(F.coalesce(text, F.lit(""))) < 30, "SHORT_TEXT")))
    return F.struct(n.alias("distinct"), F.when(n < 5, 0.4).when(n < 10, 0.7).otherwise(1.0).alias("trust"), (n < 5).alias("short"), warnings.alias("warnings"))


def coherent(words: Column, expected: Column) -> Column:
    """Does the text hold at least one word expected of what it declares? True where nothing is expected."""
    wanted = F.array_compact(expected)
    return (F.size(wanted) == 0) | F.arrays_overlap(F.array_compact(words), wanted)


def explain(dims: Column, k: int = 3) -> Column:
    """Names of the strongest dimensions."""
    ordered = F.array_sort(F.transform(dims, lambda d: F.struct((-d["points"]).alias("p"), d["name"].alias("name"))))
    return F.transform(F.slice(ordered, 1, k), lambda d: d["name"])


