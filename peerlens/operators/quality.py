"""Fill rates, section quality and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import text as tx


def fill_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, filled, total, rate: one pass, then one row for each field."""
    counted = df.agg(F.count("*").alias("_n"), *[F.count_if(tx.absent(F.col(f).cast("string")).isNotNull()).alias(f) for f in fields])
    rows = counted.select("_n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])).alias("r"))
    return rows.select("r.field", "r.filled", F.col("_n").alias("total"), cl.share(F.col("r.filled"), F.greatest("_n", F.lit(1))).alias("rate"))


def section_kind(s: Column, paywall: list[str], shortest: int = 40) -> Column:
    """real, pro_only, weak or empty."""
    t = tx.absent(s)
    return F.when(t.isNull(), "empty").when(tx.mentions(t, paywall), "pro_only").when(F.length(t) < shortest, "weak").otherwise("real")


def upper_median(rows: DataFrame, group: str, c: str, out: str) -> DataFrame:
    """group, out: the middle value of each group, the upper one of an even number, from counts by value and not from a list of all rows."""
    counts = rows.where(F.col(c).isNotNull()).groupBy(group, c).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy(c)
    below = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_n").over(Window.partitionBy(group))
    placed = counts.withColumns({"_upto": below, "_total": total})
    return placed.where((F.col("_upto") > F.floor(F.col("_total") / 2)) & (F.col("_upto") - F.col("_n") <= F.floor(F.col("_total") / 2))).select(group, F.col(c).alias(out))


def report_text(rates: DataFrame) -> DataFrame:
    """field, line: fill rates as lines of a report."""
    return rates.select("field", F.format_string("%-24s %8d / %8d  %6.2f %%", "field", "filled", "total", F.col("rate") * 100).alias("line"))


def report_json(metrics: DataFrame, key: str) -> DataFrame:
    """key, value: a row of metrics as JSON, absent ones included as null."""
    return metrics.select(key, F.to_json(F.struct(*metrics.columns), {"ignoreNullFields": "false"}).alias("value"))


def ir_metrics(ranked: DataFrame, truth: DataFrame, query: str, key: str, k: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Precision at k (over min(k, expected)), recall at 10 and reciprocal rank of each query with expected rows."""
    expected = truth.groupBy(query).agg(F.count("*").alias("expected"))
    hits = truth.join(ranked.select(query, key, "rank"), [query, key]).groupBy(query).agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= n).alias(f"hits_{n}") for n in {*k, 10}])
    out = expected.join(hits, query, "left")
    precision = [cl.share(F.coalesce(f"hits_{n}", F.lit(0)), F.least(F.lit(n), "expected")).alias(f"p_at_{n}") for n in k]
    return out.select(query, "expected", *precision, cl.share(F.coalesce("hits_10", F.lit(0)), F.col("expected")).alias("recall_at_10"), cl.round4(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"))


def _told(section: Column) -> tuple[Column, Column, Column]:
    """Letters of the content, items and subsections of a section struct; 0 where there are none."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return F.length(F.trim(F.coalesce(section["content"], F.lit("")))), size(section["items"]), size(section["subsections"])


def section_loose(section: Column, paywall: list[str]) -> Column:
    """Does a section (content, items, subsections) hold anything: 80 letters, an item, a subsection, or 40 letters that sell nothing?"""
    letters, items, parts = _told(section)
    return F.coalesce((letters >= 80) | (items > 0) | (parts > 0) | ((letters >= 40) & ~tx.mentions(section["content"], paywall)), F.lit(False))


def section_strict(section: Column, paywall: list[str]) -> Column:
    """Does it read like a report: nothing that sells, and a subsection, two items or 80 letters?"""
    letters, items, parts = _told(section)
    return F.coalesce(~tx.mentions(section["content"], paywall) & ((parts > 0) | (items >= 2) | (letters >= 80)), F.lit(False))


def report_quality(reports: DataFrame, sections: list[str], paywall: list[str], most: int = 25) -> DataFrame:
    """kind, key, strict, loose, n: how many reports have each section, sources and a build plan, by the strict and the loose rule; the histogram of strict sections; totals.

    reports: the sections as structs (content, items, subsections), sources (array), build_plan (struct with a title too). One pass: each report
    becomes a struct of flags, which are counted together. kinds: section, strict_sections (key 0 to their number), total (reports, all_sections, complete).
    """
    strict = {c: section_strict(F.col(c), paywall) for c in sections}
    loose = {c: section_loose(F.col(c), paywall) for c in sections}
    listed = F.coalesce("sources", F.array().cast("array<string>"))
    letters = F.aggregate(listed, F.lit(0), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)))
    plan_letters, plan_items, plan_parts = _told(F.col("build_plan"))
    titled = tx.absent(F.col("build_plan.title")).isNotNull()
    strict["sources"] = (letters >= 60) & ~tx.mentions(F.array_join(F.slice(listed, 1, most), " "), paywall)
    loose["sources"] = letters >= 40
    strict["build_plan"] = F.coalesce(titled & ~tx.mentions(F.col("build_plan.content"), paywall) & ((plan_letters >= 80) | (plan_parts > 0) | (plan_items >= 2)), F.lit(False))
    loose["build_plan"] = F.coalesce(titled | (plan_letters > 0), F.lit(False))
    flags = reports.select(*[x.alias(f"s_{c}") for c, x in strict.items()], *[x.alias(f"l_{c}") for c, x in loose.items()])
    flags = flags.withColumn("_n", sum((F.col(f"s_{c}").cast("int") for c in sections), F.lit(0)))
    whole = F.col("_n") == len(sections)
    counts = flags.agg(*[F.count_if(F.col(f"{k}_{c}")).alias(f"{k}_{c}") for k in "sl" for c in strict], *[F.count_if(F.col("_n") == i).alias(f"n_{i}") for i in range(len(sections) + 1)], F.count("*").alias("reports"), F.count_if(whole).alias("all_sections"), F.count_if(whole & F.col("s_sources") & F.col("s_build_plan")).alias("complete"))
    none = F.lit(None).cast("long")
    row = lambda kind, key, a, b, n: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), a.alias("strict"), b.alias("loose"), n.alias("n"))
    rows = [row("section", c, F.col(f"s_{c}"), F.col(f"l_{c}"), none) for c in strict] + [row("strict_sections", str(i), none, none, F.col(f"n_{i}")) for i in range(len(sections) + 1)] + [row("total", k, none, none, F.col(k)) for k in ("reports", "all_sections", "complete")]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
