"""Views of the driver's tables in the roles of the domain: companies, labelled documents, registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions import classify as cl

from .registry import load


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders as companies: segment, nation, years of first and last order, status by the last order."""
    last = F.struct("o_orderdate", "o_orderkey")
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min(F.year("o_orderdate")).alias("founded_year"),
        F.max(F.year("o_orderdate")).alias("shutdown_year"),
        F.max_by("o_orderstatus", last).alias("_s"),
        F.count("*").alias("n_orders"),
    )
    rows = load(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("_s") == "F", "Inactive").when(F.col("_s") == "O", "Active").otherwise("Acquired")
    rows = rows.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("category"), F.lower("n_name").alias("country"), "founded_year", "shutdown_year", status.alias("status"), "n_orders", F.col("c_acctbal").alias("balance"))
    return rows.withColumns({"outcome": cl.outcome(F.col("status")), "decade": cl.decade(F.col("founded_year"))})


COMPANIES = """
company AS (
  SELECT c_custkey AS company_id, c_name AS name, lower(c_mktsegment) AS category, lower(n_name) AS country, founded_year, shutdown_year,
    CASE s WHEN 'F' THEN 'Inactive' WHEN 'O' THEN 'Active' ELSE 'Acquired' END AS status,
    CASE s WHEN 'F' THEN 'dead' WHEN 'O' THEN 'operating' ELSE 'acquired' END AS outcome, n_orders, c_acctbal AS balance,
    ((founded_year // 10) * 10)::INTEGER::VARCHAR || 's' AS decade
  FROM customer JOIN (
    SELECT o_custkey, min(year(o_orderdate))::INTEGER AS founded_year, max(year(o_orderdate))::INTEGER AS shutdown_year,
      arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, count(*) AS n_orders
    FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
  JOIN nation ON n_nationkey = c_nationkey)"""

#: The companies that stand for queries, against all.
ASKED = "company_id % 100 = 0"


def round4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def sql_tokens(c: str, stopwords: list[str]) -> str:
    from peerlens.functions import lexicons as lx

    stop = ", ".join(f"'{w}'" for w in stopwords)
    found = f"regexp_extract_all(translate(lower(coalesce({c}, '')), '{lx.ACCENTED}', '{lx.FOLDED}'), '[a-z][a-z0-9]{{2,}}')"
    return f"list_filter({found}, lambda t: t NOT IN ({stop}))" if stopwords else found
