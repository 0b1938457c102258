"""Segment statistics by signature.

A segment is every company that shares a macro with a query. Companies are counted once, by the set of their macros (the signature), outcome,
cause and country. Queries are reduced to their distinct sets of macros; a set meets the signatures it shares a macro with in an equi-join,
and counts are added up. So companies are read once whatever the number of queries, and no pair of a query and a company arises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import text as tx
from peerlens.sources.sinks import stored

from . import cohorts, textindex


def signature(macros: Column) -> Column:
    """The sorted set of an array of macros; null is the empty set."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(macros, F.array().cast("array<string>")))))


def cells(companies: DataFrame) -> DataFrame:
    """signature, outcome, cause, inferred, country, n: all that segments are asked for, from one pass over companies (macros, outcome, cause, cause_inferred, country)."""
    rows = companies.select(
        signature(F.col("macros")).alias("signature"),
        F.coalesce("outcome", F.lit("unknown")).alias("outcome"),
        tx.absent(F.col("cause")).alias("cause"),
        F.coalesce("cause_inferred", F.lit(False)).alias("inferred"),
        tx.absent(F.col("country")).alias("country"),
    )
    return stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "segment-cells")


def met(queries: DataFrame, signatures: DataFrame, macros: str = "macros") -> DataFrame:
    """asked, signature: distinct sets of macros of queries and of companies that have a macro in common."""
    asked = queries.select(signature(F.col(macros)).alias("asked")).distinct().select("asked", F.explode("asked").alias("macro"))
    has = signatures.select("signature").distinct().select("signature", F.explode("signature").alias("macro"))
    return asked.join(has, "macro").select("asked", "signature").distinct()


def of_queries(queries: DataFrame, companies_cells: DataFrame, macros: str = "macros") -> DataFrame:
    """asked, outcome, cause, inferred, country, n of each distinct set of macros that queries ask."""
    rows = met(queries, companies_cells, macros).join(companies_cells, "signature")
    return rows.groupBy("asked", "outcome", "cause", "inferred", "country").agg(F.sum("n").alias("n"))


def outcomes(found: DataFrame) -> DataFrame:
    """asked, operating, acquired, dead, unknown, total."""
    return found.groupBy("asked").agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).alias(o) for o in cohorts.OUTCOMES], F.sum("n").alias("total"))


def _most(rows: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """asked, out: the k most frequent values with their counts, ties by name."""
    counts = rows.where(F.col(value).isNotNull()).groupBy("asked", F.col(value).alias("value")).agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("n"), "value"))
    best = counts.withColumn("nth", nth).where(F.col("nth") <= k)
    return best.groupBy("asked").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(out))  # k entries at most


def stats(queries: DataFrame, companies_cells: DataFrame, macros: str = "macros", cause: str = "cause", causes: int = 8, countries: int = 6) -> DataFrame:
    """query_id, outcome counts, total, matching (companies of the query's cause), documented, inferred and countries: lists of (value, n).

    A query without macros has an empty segment. A query without a cause is matched by companies without one.
    """
    found = stored(of_queries(queries, companies_cells, macros), "segment-counts")
    by_cause = found.groupBy("asked", tx.compact_key(F.col("cause")).alias("_key")).agg(F.sum("n").alias("matching"))
    asked = queries.select("query_id", signature(F.col(macros)).alias("asked"), tx.compact_key(F.col(cause)).alias("_key"))
    rows = asked.join(outcomes(found), "asked", "left").join(by_cause, ["asked", "_key"], "left")
    rows = rows.join(_most(found.where("not inferred"), "cause", causes, "documented"), "asked", "left")
    rows = rows.join(_most(found.where("inferred"), "cause", causes, "inferred"), "asked", "left")
    rows = rows.join(_most(found, "country", countries, "countries"), "asked", "left")
    none = F.array().cast("array<struct<value:string,n:bigint>>")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in (*cohorts.OUTCOMES, "total", "matching")]
    return rows.select("query_id", *numbers, *[F.coalesce(c, none).alias(c) for c in ("documented", "inferred", "countries")])


def totals(companies_cells: DataFrame, causes: int = 8) -> DataFrame:
    """One row: outcome counts of all companies, those with a cause, and the most frequent causes."""
    everything = companies_cells.withColumn("asked", F.lit("all"))
    with_cause = companies_cells.agg(F.coalesce(F.sum(F.when(F.col("cause").isNotNull(), F.col("n"))), F.lit(0)).alias("with_cause"), F.lit("all").alias("asked"))
    top = _most(everything, "cause", causes, "causes")
    return outcomes(everything).join(with_cause, "asked").join(top, "asked", "left").drop("asked")


def _support(size: Column) -> Column:
    """Companies of a side that a term needs."""
    return F.greatest(F.lit(3), F.floor(size / 12))


def contrast(queries: DataFrame, companies: DataFrame, postings: DataFrame, key: str = "company_id", macros: str = "macros", n: int = 10, shortest: int = 3) -> DataFrame:
    """query_id, side ('survivors' or 'dead'), rank, term, support, delta: terms whose mean weight on one side of a segment exceeds that on the other.

    postings: key, term, w. A term needs max(3, size / 12) companies on its side. Weights are added up by signature and side in one pass over the postings.
    """
    alive = F.when(F.col("outcome").isin("acquired", "operating"), True).when(F.col("outcome") == "dead", False)
    sides = companies.select(key, signature(F.col("macros")).alias("signature"), alive.alias("alive")).where("alive is not null and size(signature) > 0")
    terms = stored(postings.join(sides, key).groupBy("signature", "alive", "term").agg(F.sum("w").alias("w"), F.count("*").alias("n")), "segment-terms")
    sizes = stored(sides.groupBy("signature", "alive").agg(F.count("*").alias("n")), "segment-sides")
    pairs = stored(met(queries, sizes, macros), "segment-met")

    def both(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("alive") == a, F.col(c))), F.lit(0)).alias(f"{c}{int(a)}") for c in columns for a in (False, True)])

    count = both(pairs.join(sizes, "signature"), ["asked"], ["n"]).withColumnsRenamed({"n0": "dead", "n1": "living"})
    # no segment has more companies with a term than there are, so a term needs as many as the smallest segment asks for; it keeps both of its sides
    least = count.agg(*[F.min(_support(F.col(c))).alias(c) for c in ("living", "dead")]).first()
    total = lambda a: F.coalesce(F.sum(F.when(F.col("alive") == a, F.col("n"))), F.lit(0))
    enough = (F.col("living") >= F.lit(least["living"])) | (F.col("dead") >= F.lit(least["dead"]))
    common = terms.where(F.length("term") >= shortest).groupBy("term").agg(total(True).alias("living"), total(False).alias("dead")).where(enough).select("term")
    terms = terms.join(textindex.carried(stored(common, "segment-common")), "term", "left_semi")
    rows = both(pairs.join(terms, "signature"), ["asked", "term"], ["w", "n"]).join(count, "asked")
    mean = lambda w, size: F.coalesce(F.try_divide(w, size), F.lit(0.0))
    gap = mean(F.col("w1"), F.col("living")) - mean(F.col("w0"), F.col("dead"))
    side = F.explode(F.array(F.struct(F.lit("survivors").alias("side"), F.col("n1").alias("support"), F.col("living").alias("size"), gap.alias("delta")), F.struct(F.lit("dead").alias("side"), F.col("n0").alias("support"), F.col("dead").alias("size"), (-gap).alias("delta"))))
    told = rows.select("asked", "term", side.alias("s")).select("asked", "term", "s.*").where((F.col("delta") > 0) & (F.col("support") >= _support(F.col("size"))))
    order = Window.partitionBy("asked", "side").orderBy(F.desc(F.round("delta", 9)), "term")
    best = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return queries.select("query_id", signature(F.col(macros)).alias("asked")).join(best, "asked").select("query_id", "side", "rank", "term", "support", "delta")
