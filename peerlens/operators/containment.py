"""Pairs of texts of which one contains the other, by equal keys in place of a comparison of all pairs.

Every place of the longer text is read at each length that a shorter one has, and the pieces meet the shorter texts in an equi-join. Distinct
texts only are compared; results go back to the rows by the text. The work is letters of the distinct texts x distinct lengths, so it
suits short texts (categories, names, keywords) whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.functions import text as tx
from peerlens.sources.sinks import stored


def contained(parts: DataFrame, part: str, wholes: DataFrame, whole: str) -> DataFrame:
    """part, whole: distinct texts of which the first lies within the second; null and empty texts lie within nothing."""
    small = parts.select(F.col(part).alias("part")).where("part <> ''").distinct()
    large = wholes.select(F.col(whole).alias("whole")).where("whole <> ''").distinct()
    lengths = sorted(r["n"] for r in small.select(F.length("part").alias("n")).distinct().collect())  # as many as the longest text has letters at most
    if not lengths:
        return large.select(F.lit("").alias("part"), "whole").where("false")
    n = F.length("whole")
    sizes = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda k: k <= n)
    pieces = F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("whole"), i, k)))))
    return large.select("whole", F.explode(pieces).alias("part")).join(small, "part").select("part", "whole")


def within_each_other(a: DataFrame, left: str, b: DataFrame, right: str) -> DataFrame:
    """left, right: distinct texts of two tables of which either contains the other."""
    one = contained(a, left, b, right).select(F.col("part").alias(left), F.col("whole").alias(right))
    other = contained(b, right, a, left).select(F.col("whole").alias(left), F.col("part").alias(right))
    return one.unionByName(other).distinct()


def keyword_table(spark, macros: dict[str, list[str]]) -> DataFrame:
    """macro, keyword: a table of keywords as rows."""
    return spark.createDataFrame([(m, k) for m, ks in macros.items() for k in ks], "macro string, keyword string")


def category_key(category: Column) -> Column:
    """Category as it meets keywords: lower case, trimmed, without accents."""
    return tx.fold_accents(F.trim(F.coalesce(category, F.lit(""))))


def category_macros(categories: DataFrame, category: str, keywords: DataFrame) -> DataFrame:
    """category, macros: for each distinct category the sorted macros of which a keyword contains it or lies within it; categories without any are left out."""
    # stored: it is read five times, and the rows behind it may be all words of all texts
    rows = stored(categories.select(F.col(category).alias("category")).distinct().withColumn("_key", category_key(F.col("category"))), "categories")
    met = within_each_other(rows, "_key", keywords, "keyword")
    found = met.join(keywords, "keyword").groupBy("_key").agg(F.array_sort(F.collect_set("macro")).alias("macros"))  # macros are few
    return rows.join(found, "_key").select("category", "macros")


def with_macros(df: DataFrame, keywords: DataFrame, categories: str = "categories", out: str = "macros") -> DataFrame:
    """df with the sorted macros of an array of categories. Categories are looked up in a map of the distinct ones if they are few, else joined by row."""
    table = category_macros(df.select(F.explode(categories).alias("_c")), "_c", keywords)
    if table.limit(MAP_ROWS + 1).count() <= MAP_ROWS:
        found = table.agg(F.map_from_entries(F.collect_list(F.struct("category", "macros"))).alias("_m"))
        listed = F.flatten(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.coalesce(F.when(c.isNotNull(), F.element_at(F.col("_m"), c)), F.array().cast("array<string>"))))
        return df.join(F.broadcast(found)).withColumn(out, F.array_sort(F.array_distinct(listed))).drop("_m")
    mark = df.withColumn("_set", F.array_sort(F.array_distinct(F.coalesce(categories, F.array().cast("array<string>")))))
    sets = mark.select("_set").distinct().select("_set", F.explode("_set").alias("category")).join(table, "category").groupBy("_set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("macros")))).alias(out))
    return mark.join(sets, "_set", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).drop("_set")


#: Distinct categories that are broadcast as one map.
MAP_ROWS = 20_000
