"""Queries over clusters, causes, payloads, bulk files, table functions and sitemaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.functions import sql as fsql
from peerlens.functions import text as tx
from peerlens.operators import graph, vectors
from peerlens.sources import adapters, html, sinks

from . import consult
from .analogs import round4
from .registry import load, query, values
from .source_queries import _graph, _page
from .vector_queries import CENTS, NEAR

PROFILED = f"""{CENTS}, {NEAR}, r AS (SELECT vec_id, near.cluster_id, round(distance, 9) AS distance, 'c' || (vec_id % 7) AS category, CASE WHEN vec_id % 5 < 3 THEN 'us' ELSE 'n' || (vec_id % 4) END AS country, CASE vec_id % 3 WHEN 0 THEN '' ELSE 'm' || (vec_id % 3) END AS model,
  CASE vec_id % 3 WHEN 0 THEN 'dead' WHEN 1 THEN 'operating' ELSE 'acquired' END AS outcome FROM near)"""


@query(f"""
WITH {PROFILED},
c AS (SELECT cluster_id, category AS v, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, category) AS k FROM r GROUP BY cluster_id, category),
g AS (SELECT cluster_id, country AS v, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, country) AS k FROM r GROUP BY cluster_id, country),
m AS (SELECT cluster_id, model AS v, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, model) AS k FROM r WHERE model <> '' GROUP BY cluster_id, model),
x AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, outcome = 'dead' ORDER BY distance, vec_id) AS k FROM r)
SELECT cluster_id, (SELECT count(*) FROM r WHERE r.cluster_id = o.cluster_id) AS size, (SELECT array_to_string(list(v ORDER BY k), '|') FROM c WHERE c.cluster_id = o.cluster_id AND k <= 6) AS categories,
  (SELECT array_to_string(list(v ORDER BY k), '|') FROM g WHERE g.cluster_id = o.cluster_id AND k <= 5) AS countries,
  concat_ws(' · ', (SELECT v FROM c WHERE c.cluster_id = o.cluster_id AND k = 1), (SELECT v FROM c WHERE c.cluster_id = o.cluster_id AND k = 2 AND n > 0.5 * (SELECT n FROM c d WHERE d.cluster_id = o.cluster_id AND d.k = 1)),
    (SELECT v FROM m WHERE m.cluster_id = o.cluster_id AND k = 1), (SELECT v || '-dominado' FROM g WHERE g.cluster_id = o.cluster_id AND k = 1 AND n > 0.5 * (SELECT sum(n) FROM g h WHERE h.cluster_id = o.cluster_id AND h.k <= 5))) AS label,
  (SELECT array_to_string(list(vec_id ORDER BY k), '|') FROM x WHERE x.cluster_id = o.cluster_id AND outcome <> 'dead' AND k <= 3) AS living, (SELECT array_to_string(list(vec_id ORDER BY k), '|') FROM x WHERE x.cluster_id = o.cluster_id AND outcome = 'dead' AND k <= 3) AS dead
FROM (SELECT DISTINCT cluster_id FROM r) o
""")
def cluster_profiles(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    rows = vectors.placed(e, vectors.centroids(e, "label")).select(
        i, "cluster_id", "distance", F.concat(F.lit("c"), (i % 7).cast("string")).alias("category"), F.when(i % 5 < 3, "us").otherwise(F.concat(F.lit("n"), (i % 4).cast("string"))).alias("country"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("m"), (i % 3).cast("string"))).alias("model"), F.when(i % 3 == 0, "dead").when(i % 3 == 1, "operating").otherwise("acquired").alias("outcome"),
    )
    out = vectors.cluster_profiles(rows, "vec_id")
    names = lambda c: F.array_join(F.transform(c, lambda x: x["value"]), "|")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return out.select("cluster_id", "size", names("top_category").alias("categories"), names("top_country").alias("countries"), "label", joined("living").alias("living"), joined("dead").alias("dead"))


@query(f"WITH {CENTS}, {NEAR} SELECT {round4('sum(distance * distance)')} AS inertia FROM near")
def cluster_inertia(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return vectors.inertia(vectors.placed(e, vectors.centroids(e, "label"))).select(cl.round4(F.col("inertia")).alias("inertia"))


STORIES = ["We ran out of cash and could not raise.", "There was no demand, a lawsuit, and the cofounder left.", "It was too early", "Short", "A plain story without any reason at all."]


def _fixed_causes() -> str:
    rows = " UNION ALL ".join(f"SELECT o_orderkey, {k} AS ord, '{c}' AS cause, {' + '.join('contains(t, ' + chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) + ')::INT' for p in ps)} AS n FROM d" for k, (c, ps) in enumerate(lx.CAUSE_LEXICON.items()))
    return f"""
WITH s(k, t) AS (VALUES {values(list(enumerate(STORIES)))}), d AS (SELECT o_orderkey, lower(t) || repeat(' ', 5) AS t FROM orders JOIN s ON k = o_orderkey % {len(STORIES)}),
h AS (SELECT * FROM ({rows}) WHERE n > 0), g AS (SELECT o_orderkey, count(*) AS causes, arg_max(cause, (n, -ord)) AS best, max(n) AS most FROM h GROUP BY o_orderkey)
SELECT o_orderkey, CASE WHEN causes >= 3 THEN 'Multiple Reasons' ELSE best END AS cause, CASE WHEN causes >= 3 THEN 'medium' WHEN most >= 2 THEN 'high' ELSE 'low' END AS confidence FROM g"""


@query(_fixed_causes())
def cause_fixed_lexicon(spark, sf_dir):
    text = F.concat(F.get(F.array(*[F.lit(s) for s in STORIES]), (F.col("o_orderkey") % len(STORIES)).cast("int")), F.lit("     "))
    c = cl.infer_cause(text, lx.CAUSE_LEXICON)
    # a generator, since a filter on the struct and each of its fields would compute it again
    return load(spark, sf_dir, "orders").select("o_orderkey", F.inline_outer(F.array(c))).where("cause is not null").select("o_orderkey", "cause", "confidence")


NAMES = ["Brasil", "U.S.A.", "usa", "Reino Unido", "Atlantis", " EUA ", ""]


@query(f"""
WITH n(k, s) AS (VALUES {values(list(enumerate(NAMES)))}), a(x, y) AS (VALUES {values(list(lx.COUNTRY_ALIASES.items()))})
SELECT c_custkey, coalesce(y, regexp_replace(lower(trim(s)), '[^\\w\\s]', '', 'g')) AS country FROM customer JOIN n ON k = c_custkey % {len(NAMES)} LEFT JOIN a ON x = regexp_replace(lower(trim(s)), '[^\\w\\s]', '', 'g')
""")
def country_fixed_aliases(spark, sf_dir):
    s = F.get(F.array(*[F.lit(x) for x in NAMES]), (F.col("c_custkey") % len(NAMES)).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", tx.country_key(s, lx.COUNTRY_ALIASES).alias("country"))


_MATCHES = "m AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS final_rank, 'S' || l_suppkey AS name, CASE l_linenumber % 2 WHEN 0 THEN 'dead' ELSE 'operating' END AS outcome, floor(l_quantity)::INT AS score FROM lineitem)"


def _matches(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_quantity"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), rank.alias("final_rank"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), F.when(F.col("l_linenumber") % 2 == 0, "dead").otherwise("operating").alias("outcome"), F.floor("l_quantity").cast("int").alias("score"), F.lit("low").alias("confidence"), F.array(F.lit("era"), F.lit("macro")).alias("reasons"))


@query(f"""
WITH {_MATCHES} SELECT query_id, '{{"matches":[' || string_agg('{{"final_rank":' || final_rank || ',"name":"' || name || '","outcome":"' || outcome || '","score":' || score || ',"confidence":"low","reasons":["era","macro"]}}', ',' ORDER BY final_rank) || ']}}' AS payload FROM m GROUP BY query_id
""")
def match_payload(spark, sf_dir):
    return consult.payload(_matches(spark, sf_dir))


@query(f"""
WITH {_MATCHES} SELECT query_id, string_agg(format('{{:>2d}}. {{}} [{{}}] {{}}.0 (low): era, macro', final_rank, name, outcome, score), chr(10) ORDER BY final_rank) AS report FROM m GROUP BY query_id
""")
def match_report(spark, sf_dir):
    return consult.report(_matches(spark, sf_dir).withColumn("score", F.col("score").cast("double")))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'The input is too short for a verdict.' WHEN c_custkey % 3 = 0 THEN 'Your closest peers died more often than your segment: ' || (c_custkey % 100) || ' % of them.' WHEN c_custkey % 3 = 1 THEN 'Your closest peers survived more often than your segment.' WHEN c_custkey % 7 = 0 THEN 'There are too few peers to tell.' ELSE 'Your closest peers fared as your segment did.' END AS verdict FROM customer
""")
def verdict_texts(spark, sf_dir):
    i = F.col("c_custkey")
    direction = F.when(i % 3 == 0, "NEGATIVO").when(i % 3 == 1, "POSITIVO").when(i % 7 == 0, "SEM_MATCHES").otherwise("NEUTRO")
    return load(spark, sf_dir, "customer").select("c_custkey", consult.verdict(direction, (i % 100) / 100, i % 5 == 0).alias("verdict"))


@query("""
SELECT 'COMPANY:' || s_name AS id, 'COMPANY' AS label, s_suppkey::VARCHAR AS age, s_name || ' & <co>' AS name FROM supplier UNION ALL SELECT DISTINCT 'COUNTRY:' || n_name, 'UNKNOWN', NULL, 'COUNTRY:' || n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def bulk_files(spark, sf_dir):
    """Bulk CSV with all attributes, written and read back."""
    nodes, edges = _graph(spark, sf_dir)
    ages = load(spark, sf_dir, "supplier").select(F.concat(F.lit("COMPANY:"), "s_name").alias("id"), F.col("s_suppkey").alias("age"))
    path = sinks.scratch(spark, "bulk")
    graph.write_bulk(nodes.join(ages, "id", "left"), graph.with_origin(edges, "a"), path)
    back = spark.read.csv(f"{path}/nodes", header=True)
    return back.select(F.col("id:ID").alias("id"), F.col(":LABEL").alias("label"), "age", "name")


@query("""
SELECT c_custkey AS page_id, c_mktsegment AS heading, 0 AS node, 'a|b' AS items FROM customer UNION ALL SELECT c_custkey, 'Sub', 1, '' FROM customer
""")
def outline_function(spark, sf_dir):
    """The table function of page sections, in SQL text."""
    fsql.register_tables(spark)
    _page(spark, sf_dir, "<h2>", F.col("c_mktsegment"), "</h2><ul><li>a</li><li>b</li></ul><h3>Sub</h3>").createOrReplaceTempView("peerlens_pages")
    return spark.sql("SELECT page_id, heading, node, array_join(items, '|') AS items FROM peerlens_pages, LATERAL html_outline(html)")


@query(r"""
SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS compact, regexp_replace(regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS entity, 'acquired' AS outcome, len(regexp_extract_all(lower(s_name), '[a-z][a-z0-9]{2,}')) AS tokens FROM supplier
""")
def sql_functions(spark, sf_dir):
    fsql.register(spark)
    load(spark, sf_dir, "supplier").createOrReplaceTempView("peerlens_suppliers")
    return spark.sql("SELECT s_suppkey, compact_key(s_name) AS compact, entity_key(s_name) AS entity, outcome_bucket('was acquired') AS outcome, cast(size(text_tokens(s_name)) AS bigint) AS tokens FROM peerlens_suppliers")


@query("""
SELECT DISTINCT 'https://h.io/company/' || lower(c_mktsegment) AS url, 'company' AS kind FROM customer UNION ALL SELECT 'https://h.io/', 'page'
""")
def sitemap_pages(spark, sf_dir):
    files = load(spark, sf_dir, "customer").select(F.concat(F.lit("<urlset><url><loc> https://h.io/company/"), F.lower("c_mktsegment"), F.lit(" </loc></url><url><loc>https://h.io/</loc><broken & xml")).alias("value"))
    return adapters.sitemap_locations(files)


@query("SELECT 'Companies of ' || y || ' in ' || n_name AS name, y::INT AS year FROM nation, range(2008, 2011) AS r(y)")
def expanded_names(spark, sf_dir):
    templates = load(spark, sf_dir, "nation").select(F.concat(F.lit("Companies of {year} in "), F.col("n_name")).alias("template"))
    return html.expanded(templates, 2008, 2010).select("name", "year")


@query("SELECT count(*) AS n, count(*) AS ids, count(*) AS tokens, true AS safe FROM customer")
def random_ids(spark, sf_dir):
    rows = sinks.stored(load(spark, sf_dir, "customer").select(tx.unique_id().alias("id"), tx.token().alias("token")), "ids")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("token").alias("tokens"), F.every(F.col("token").rlike("^[A-Za-z0-9_-]{22}$")).alias("safe"))
