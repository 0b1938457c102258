"""The main keys and buckets as SQL functions, so that SQL text can use them; they inline into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import lexicons as lx


def _any(needles: list[str], c: str = "s") -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{n}')" for n in needles) + ")"


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    suffix = "|".join(s.replace(".", "\\\\.") for s in sorted(lx.CORPORATE_SUFFIXES, key=len, reverse=True))
    stop = ", ".join(f"'{w}'" for w in lx.STOPWORDS)
    bodies = {
        "compact_key(s STRING) RETURNS STRING": "regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]+', '')",
        "entity_key(s STRING) RETURNS STRING": f"regexp_replace(regexp_replace(regexp_replace(lower(trim(s)), '\\\\b({suffix})\\\\b\\\\.?', ''), '[^a-z0-9]+', '-'), '^-+|-+$', '')",
        "fold_accents(s STRING) RETURNS STRING": f"translate(lower(s), '{lx.ACCENTED}', '{lx.FOLDED}')",
        "text_tokens(s STRING) RETURNS ARRAY<STRING>": f"filter(regexp_extract_all(translate(lower(coalesce(s, '')), '{lx.ACCENTED}', '{lx.FOLDED}'), '[a-z][a-z0-9]{{2,}}', 0), t -> t NOT IN ({stop}))",
        "outcome_bucket(s STRING) RETURNS STRING": f"CASE WHEN contains(lower(s), 'acquired') THEN 'acquired' WHEN {_any(lx.DEAD_MARKERS)} THEN 'dead' WHEN {_any(lx.OPERATING_MARKERS)} THEN 'operating' ELSE 'unknown' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in bodies]


def register_tables(spark: SparkSession) -> list[str]:
    """Registers table functions: html_outline(html) gives node, parent, level, heading, content and items of a page's sections."""
    from pyspark.sql.functions import udtf

    from peerlens.sources.html import tree_of

    @udtf(returnType="node int, parent int, level int, heading string, content string, items array<string>")
    class Outline:
        def eval(self, html: str):
            for m in tree_of(html):
                yield m["node"], m["parent"], m["level"], m["heading"], "\n".join(m["content"]), m["items"]

    spark.udtf.register("html_outline", Outline)
    return ["html_outline"]
