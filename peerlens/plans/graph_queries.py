"""Queries over the entity graph of companies, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.operators import graph

from .analogs import COMPANIES, companies
from .registry import load, query

GRAPH = f"""{COMPANIES},
e AS (SELECT DISTINCT * FROM (
  SELECT 'COMPANY:' || company_id AS source, 'CATEGORY:' || category AS target, 'IN_CATEGORY' AS relation FROM company
  UNION ALL SELECT 'COMPANY:' || company_id, 'LOCATION:' || country, 'LOCATED_IN' FROM company
  UNION ALL SELECT 'COMPANY:' || company_id, 'OUTCOME:' || outcome, 'HAS_OUTCOME' FROM company
  UNION ALL SELECT 'COMPANY:' || company_id, 'SOURCE:crm', 'FROM_SOURCE' FROM company)),
n AS (SELECT 'COMPANY:' || company_id AS id, 'company' AS type, name FROM company
  UNION SELECT 'CATEGORY:' || category, 'category', category FROM company UNION SELECT 'LOCATION:' || country, 'location', country FROM company
  UNION SELECT 'OUTCOME:' || outcome, 'outcome', outcome FROM company UNION SELECT 'SOURCE:crm', 'unknown', 'SOURCE:crm')"""


def _graph(spark, sf_dir):
    c = companies(spark, sf_dir)
    own = graph.node_id("company", F.col("company_id").cast("string"))
    dims = {"category": "IN_CATEGORY", "country": "LOCATED_IN", "outcome": "HAS_OUTCOME"}
    kinds = {"category": "category", "country": "location", "outcome": "outcome"}
    edges = graph.distinct_edges([*[graph.edges_of(c, own, r, graph.node_id(kinds[f], F.col(f))) for f, r in dims.items()], graph.edges_of(c, own, "FROM_SOURCE", F.lit("SOURCE:crm"))])
    declared = [c.select(own.alias("id"), F.lit("company").alias("type"), "name"), *[c.select(graph.node_id(kinds[f], F.col(f)).alias("id"), F.lit(kinds[f]).alias("type"), F.col(f).alias("name")).distinct() for f in dims]]
    return graph.nodes_of(declared, edges), edges


@query(f"WITH {GRAPH} SELECT * FROM n")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@query(f"WITH {GRAPH} SELECT * FROM e")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(f"WITH {GRAPH} SELECT type, count(*) AS n FROM n GROUP BY type")
def graph_type_counts(spark, sf_dir):
    return graph.type_counts(_graph(spark, sf_dir)[0])


@query("""
WITH b AS (SELECT DISTINCT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS s FROM orders)
SELECT 'BATCH:' || y || 'Q' || s AS source, lead('BATCH:' || y || 'Q' || s) OVER (ORDER BY y, s) AS target, 'FOLLOWED_BY' AS relation FROM b QUALIFY target IS NOT NULL
""")
def graph_batch_chain(spark, sf_dir):
    b = load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("s")).distinct()
    return graph.chain(b.withColumn("node", F.concat(F.lit("BATCH:"), "y", F.lit("Q"), "s")), "node", ["y", "s"])


_LINKS = "l AS (SELECT DISTINCT 'C' || o_custkey AS source, 'P' || l_partkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"""
WITH {_LINKS}, u AS (SELECT source, target FROM l UNION SELECT target, source FROM l), s AS (SELECT 'C' || c_custkey AS seed FROM customer WHERE c_custkey % 100 = 0),
h1 AS (SELECT DISTINCT seed, target AS id FROM s JOIN u ON source = seed), h2 AS (SELECT DISTINCT seed, target AS id FROM h1 JOIN u ON source = id)
SELECT seed, id, min(hops)::INT AS hops FROM (SELECT seed, seed AS id, 0 AS hops FROM s UNION ALL SELECT seed, id, 1 FROM h1 UNION ALL SELECT seed, id, 2 FROM h2) GROUP BY seed, id
""")
def graph_two_hop(spark, sf_dir):
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = joined.select(F.concat(F.lit("C"), "o_custkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target"))
    seeds = load(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("seed"))
    return graph.neighbourhood(edges, seeds)


@query(f"WITH {GRAPH}, k AS (SELECT id FROM n WHERE type NOT IN ('location', 'outcome')) SELECT * FROM e WHERE relation NOT IN ('FROM_SOURCE', 'HAS_DATA_SOURCE') AND source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def graph_filter_semi(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.without_types(nodes, edges, ["location", "outcome"], graph.HEAVY)[1].select("source", "target", "relation")


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM o WHERE n <= 700 OR ceil(r * 700 / n) < ceil((r + 1) * 700 / n)
""")
def edge_sample_step(spark, sf_dir):
    return graph.systematic_sample(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 700)


@query(f"""WITH {GRAPH} SELECT 'node' AS kind, id AS a, upper(type) AS b, name AS c FROM n UNION ALL SELECT 'edge', source, target, relation FROM e""")
def neo4j_export_rows(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.bulk_nodes(nodes).select(F.lit("node").alias("kind"), F.col("`id:ID`").alias("a"), F.col("`:LABEL`").alias("b"), F.col("name").alias("c")).unionByName(
        graph.bulk_edges(edges).select(F.lit("edge").alias("kind"), F.col("`:START_ID`").alias("a"), F.col("`:END_ID`").alias("b"), F.col("`:TYPE`").alias("c"))
    )
