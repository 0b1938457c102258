"""Queries over reports, lifecycle tables, graphs and matches made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.operators import graph, lifecycle, linkage, quality, reports, scoring
from peerlens.sources import sinks

from .analogs import COMPANIES, companies
from .company_queries import SOURCES, _sources
from .registry import load, query
from .source_queries import GRAPH, _graph

WITH_CAUSE = f"""{COMPANIES}, caused AS (SELECT *, CASE company_id % 4 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Rivals' WHEN 2 THEN ' ' END AS cause, company_id % 3 = 0 AS cause_inferred FROM company)"""


def _caused(spark, sf_dir):
    i = F.col("company_id") % 4
    return companies(spark, sf_dir).withColumns({"cause": F.when(i == 0, "Cash").when(i == 1, "Rivals").when(i == 2, " "), "cause_inferred": F.col("company_id") % 3 == 0})


@query(f"WITH {WITH_CAUSE} SELECT count(*) AS companies, count(*) FILTER (status = 'Inactive') AS dead, count(*) FILTER (trim(cause) <> '') AS with_cause, count(DISTINCT country) AS countries FROM caused")
def corpus_meta(spark, sf_dir):
    return reports.corpus_meta(_caused(spark, sf_dir))


@query(f"""
WITH {COMPANIES}, v AS (SELECT 'category' AS "column", category AS value FROM company UNION ALL SELECT 'country', country FROM company UNION ALL SELECT 'founded_year', founded_year::VARCHAR FROM company),
c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY ALL)
SELECT "column", value, n FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 5
""")
def value_counts(spark, sf_dir):
    return reports.counts(companies(spark, sf_dir), ["category", "country", "founded_year"], 5)


@query(f"""
WITH {SOURCES}, s AS (SELECT norm, count(DISTINCT source) AS k FROM src GROUP BY norm), e AS (SELECT DISTINCT norm, source FROM src)
SELECT source, (SELECT count(*) FROM src b WHERE b.source = e.source) AS records, count(*) AS entities, count(*) FILTER (k > 1) AS shared FROM e JOIN s USING (norm) GROUP BY source
""")
def source_summary(spark, sf_dir):
    return reports.source_summary(_sources(spark, sf_dir))


@query(f"WITH {SOURCES}, e AS (SELECT DISTINCT norm, source FROM src) SELECT x.source AS a, y.source AS b, count(*) AS shared FROM e x JOIN e y ON x.norm = y.norm AND x.source < y.source GROUP BY ALL")
def source_overlap(spark, sf_dir):
    return reports.source_overlap(_sources(spark, sf_dir))


SECTION = "CASE ({0}) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'short' WHEN 2 THEN 'For the text of this section, commission the analysis today' ELSE 'A real section of some length about ' || p_type END"


def _reports(spark, sf_dir):
    def section(n):
        return F.when(n % 4 == 0, None).when(n % 4 == 1, "short").when(n % 4 == 2, "For the text of this section, commission the analysis today").otherwise(F.concat(F.lit("A real section of some length about "), F.col("p_type")))

    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(k.alias("id"), section(k).alias("intro"), section(k + F.floor(k / 4)).alias("market"), F.col("p_name").alias("meta_tags"))


REPORTS = f"""r AS (SELECT p_partkey AS id, {SECTION.format('p_partkey')} AS intro, {SECTION.format('p_partkey + p_partkey // 4')} AS market FROM part),
k AS (SELECT id, section, CASE WHEN s IS NULL THEN 'empty' WHEN contains(lower(s), 'commission the') THEN 'pro_only' WHEN length(s) < 40 THEN 'weak' ELSE 'real' END AS kind FROM (SELECT id, 'intro' AS section, intro AS s FROM r UNION ALL SELECT id, 'market', market FROM r))"""


@query(f"WITH {REPORTS} SELECT section, count(*) FILTER (kind = 'real') AS \"real\", count(*) FILTER (kind = 'pro_only') AS pro_only, count(*) FILTER (kind = 'weak') AS weak, count(*) FILTER (kind = 'empty') AS \"empty\" FROM k GROUP BY section")
def section_coverage(spark, sf_dir):
    return reports.section_coverage(_reports(spark, sf_dir), ["intro", "market"], ["commission the"])


@query(f"WITH {REPORTS} SELECT id, count(*) FILTER (kind = 'real')::INT AS real_sections, count(*) FILTER (kind = 'real') = 2 AS complete FROM k GROUP BY id")
def complete_reports(spark, sf_dir):
    """The raw reports are written without their meta tags and read back."""
    path = sinks.scratch(spark, "raw")
    sinks.write_raw(_reports(spark, sf_dir), path)
    return reports.complete_reports(spark.read.schema("id long, intro string, market string").json(path), "id", ["intro", "market"], ["commission the"])


@query("SELECT label, count(*) AS n FROM (SELECT unnest([event_type, CASE WHEN value > 50 THEN 'large' ELSE 'small' END]) AS label FROM events) GROUP BY label ORDER BY n DESC, label LIMIT 4")
def label_histogram(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.array("event_type", F.when(F.col("value") > 50, "large").otherwise("small")).alias("pattern_labels"))
    return reports.label_histogram(rows, 4)


@query("""
WITH c AS (SELECT category, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS category FROM part) GROUP BY category ORDER BY n DESC, category LIMIT 12)
SELECT category, n FROM c WHERE contains(lower(category), 'e') AND category NOT IN ('STEEL') ORDER BY n DESC, category LIMIT 8
""")
def category_suggestions(spark, sf_dir):
    known = reports.known_categories(load(spark, sf_dir, "part").select(F.split("p_type", " ").alias("categories")), 12)
    return reports.suggestions(known, "E", ["STEEL"])


@query("""
WITH m AS (SELECT l_suppkey AS query_id, l_linenumber * 3 AS final_rank, CASE WHEN l_quantity < 10 THEN '' ELSE l_returnflag || l_linestatus END AS cause FROM lineitem)
SELECT query_id, cause, count(*) AS n FROM m WHERE final_rank <= 15 AND cause <> '' GROUP BY query_id, cause QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, cause) <= 2
""")
def top_causes(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_linenumber") * 3).alias("final_rank"), F.when(F.col("l_quantity") < 10, "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("cause"))
    return reports.top_causes(rows, 15, 2)


@query("""
WITH m AS (SELECT l_suppkey AS query_id, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'medium (sparse segment)' ELSE 'low' END AS c FROM lineitem)
SELECT query_id, count(*) FILTER (starts_with(c, 'high')) AS high, count(*) FILTER (starts_with(c, 'medium')) AS medium, count(*) FILTER (starts_with(c, 'low')) AS low FROM m GROUP BY query_id
""")
def confidence_counts(spark, sf_dir):
    level = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium (sparse segment)").otherwise("low")
    return reports.confidence_counts(load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), level.alias("confidence")))


@query(f"WITH {WITH_CAUSE} SELECT category, cause, count(*) AS n, count(*) FILTER (cause_inferred) AS inferred FROM caused WHERE nullif(trim(cause), '') IS NOT NULL GROUP BY category, cause QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, cause) <= 3")
def segment_causes(spark, sf_dir):
    return reports.segment_causes(_caused(spark, sf_dir))


@query(f"WITH {COMPANIES} SELECT category, country, count(*) AS n FROM company GROUP BY category, country QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, country) <= 3")
def segment_countries(spark, sf_dir):
    return reports.segment_countries(companies(spark, sf_dir))


def _asked(spark, sf_dir):
    i = F.col("c_custkey")
    none = F.array().cast("array<string>")
    return load(spark, sf_dir, "customer").select(
        i.alias("query_id"), i.alias("company_id"), F.when(i % 5 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(i % 3 == 0, "short").otherwise("a line that says enough").alias("one_liner"), F.when(i % 4 == 0, none).otherwise(F.array("c_mktsegment")).alias("categories"),
        F.when(i % 7 == 0, None).otherwise(F.lit("Lack of Funds")).alias("main_concern"), F.lit("BR").alias("country"), F.lit("2001").alias("founded_year"), F.lit("saas").alias("business_model"),
    )


@query("""
WITH q AS (SELECT c_custkey AS query_id, list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'NAME' END, CASE WHEN c_custkey % 3 = 0 THEN 'ONE_LINER' END, CASE WHEN c_custkey % 4 = 0 THEN 'CATEGORIES' END, CASE WHEN c_custkey % 7 = 0 THEN 'MAIN_CONCERN' END], lambda x: x IS NOT NULL) AS r FROM customer)
SELECT query_id, array_to_string(r, '|') AS reasons FROM q WHERE len(r) > 0
""")
def rejected_queries(spark, sf_dir):
    return reports.rejected(_asked(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "|"))


@query("""
SELECT c_custkey AS company_id, CASE WHEN c_custkey % 2 = 0 THEN 'Answered' WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name, 'BR' AS country, CASE WHEN c_custkey % 3 = 0 THEN '2010' ELSE '2001' END AS founded_year, 'saas' AS business_model FROM customer
""")
def snapshot_inheritance(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    old = reports.snapshot(asked.withColumn("country", F.lit("old")), "initial", at("2024-01-01 00:00:00"))
    snaps = old.unionByName(reports.snapshot(asked, "initial", at("2024-02-01 00:00:00")))
    i = F.col("company_id")
    answers = asked.select("company_id", F.when(i % 2 == 0, "Answered").otherwise("").alias("name"), F.lit(None).cast("string").alias("country"), F.when(i % 3 == 0, "2010").alias("founded_year"), F.lit(" ").alias("business_model"))
    return reports.inherited(answers, snaps)


_T = "TIMESTAMP '2024-01-01 00:00:00'"
_NOW = "TIMESTAMP '2024-03-01 00:00:00'"


def _time(s):
    return F.lit(s).cast("timestamp_ntz")


def _users(spark, sf_dir):
    i = F.col("c_custkey")
    t = _time("2024-01-01 00:00:00")
    return load(spark, sf_dir, "customer").where(i % 2 == 0).select(
        i.alias("company_id"), F.concat(F.lit("n"), i.cast("string")).alias("norm"), F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit("@x.org"))).alias("email"), F.lit(False).alias("consent_followup"), t.alias("created_at"), t.alias("updated_at"),
        F.when(i % 6 == 0, "silent").when(i % 10 == 0, "promoted").otherwise("active").alias("current_status"),
    )


@query(f"""
WITH u AS (SELECT c_custkey AS k, 'n' || c_custkey AS norm, CASE WHEN c_custkey % 4 = 0 THEN c_custkey || '@x.org' END AS email, CASE WHEN c_custkey % 6 = 0 THEN 'silent' WHEN c_custkey % 10 = 0 THEN 'promoted' ELSE 'active' END AS st FROM customer WHERE c_custkey % 2 = 0),
s AS (SELECT 'n' || c_custkey AS norm, CASE WHEN c_custkey % 4 = 0 THEN c_custkey || '@x.org' END AS email FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(u.norm, s.norm) AS norm, coalesce(u.email, s.email) AS email, k IS NOT NULL AS known, s.norm IS NOT NULL AS consent_followup, CASE WHEN k IS NULL THEN {_NOW} ELSE {_T} END AS created_at, CASE WHEN s.norm IS NULL THEN {_T} ELSE {_NOW} END AS updated_at, coalesce(st, 'active') AS current_status
FROM u FULL JOIN s ON u.norm = s.norm AND coalesce(u.email, '') = coalesce(s.email, '')
""")
def register_companies(spark, sf_dir):
    i = F.col("c_custkey")
    new = load(spark, sf_dir, "customer").where(i % 3 == 0).select(F.concat(F.lit("n"), i.cast("string")).alias("norm"), F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit("@x.org"))).alias("email"), F.lit(True).alias("consent_followup"), _time("2024-02-02 00:00:00").alias("submitted_at"))
    older = new.withColumns({"consent_followup": F.lit(False), "submitted_at": _time("2024-02-01 00:00:00")})
    users = _users(spark, sf_dir)
    out = lifecycle.registered(users, new.unionByName(older), _time("2024-03-01 00:00:00"))
    known = users.select("company_id", F.lit(True).alias("known"))
    return out.join(known, "company_id", "left").select("norm", "email", F.coalesce("known", F.lit(False)).alias("known"), "consent_followup", "created_at", "updated_at", "current_status")


@query("""
WITH u AS (SELECT c_custkey AS k, 'n' || c_custkey AS norm, CASE WHEN c_custkey % 6 = 0 THEN 'Inactive' ELSE 'Active' END AS st FROM customer WHERE c_custkey % 2 = 0 AND NOT (c_custkey % 10 = 0 AND c_custkey % 6 <> 0)),
c AS (SELECT 'n' || s_suppkey AS norm, s_name AS name FROM supplier)
SELECT coalesce(c.norm, u.norm) AS norm, coalesce(c.name, 'User ' || k) AS name, CASE WHEN c.norm IS NOT NULL THEN 'Active' ELSE st END AS status, CASE WHEN c.norm IS NULL THEN 'user' WHEN u.norm IS NULL THEN 'erp' ELSE 'erp|user' END AS sources
FROM c FULL JOIN u ON c.norm = u.norm
""")
def promote_companies(spark, sf_dir):
    users = _users(spark, sf_dir)
    corpus = load(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("norm"), F.col("s_name").alias("name"), F.lit("Active").alias("status"), F.lit("us").alias("country"), F.array(F.lit("erp")).alias("sources"))
    one = users.select("company_id", F.concat(F.lit("User "), F.col("company_id").cast("string")).alias("name"), F.lit("br").alias("country"))
    snaps = reports.snapshot(one.withColumn("name", F.lit("old")), "initial", _time("2024-01-01 00:00:00")).unionByName(reports.snapshot(one, "response", _time("2024-01-02 00:00:00")))
    merged, _ = lifecycle.promote(corpus, users, snaps, users.select("company_id"))
    return merged.select("norm", "name", "status", F.array_join("sources", "|").alias("sources"))


def _queue(spark, sf_dir):
    o, none = F.col("o_orderkey"), F.lit(None).cast("timestamp_ntz")
    return load(spark, sf_dir, "orders").select(o.cast("string").alias("token"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("scheduled_for"), none.alias("sent_at"), none.alias("responded_at"), F.when(o % 5 == 0, "sent").otherwise("pending").alias("status"))


@query(f"""
SELECT o_orderkey::VARCHAR AS token, CASE WHEN o_orderkey % 5 = 0 THEN 'sent' WHEN o_custkey % 7 = 0 THEN 'opted_out' WHEN o_orderkey % 3 = 0 THEN 'sent' ELSE 'pending' END AS status,
  CASE WHEN o_orderkey % 5 <> 0 AND o_custkey % 7 <> 0 AND o_orderkey % 3 = 0 THEN {_NOW} END AS sent_at FROM orders
""")
def queue_marks(spark, sf_dir):
    q = _queue(spark, sf_dir)
    out = lifecycle.opted_out(q, q.where("company_id % 7 = 0").select("company_id"))
    sent = lifecycle.marked_sent(out, q.where("cast(token as long) % 3 = 0").select("token"), _time("2024-03-01 00:00:00"))
    return sent.select("token", "status", "sent_at")


@query("""
WITH d AS (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 <> 0 AND c_custkey % 2 = 0 AND NOT (c_custkey % 10 = 0 AND c_custkey % 6 <> 0) AND o_orderdate <= TIMESTAMP '1996-01-01 00:00:00')
SELECT count(*) AS due, count(*) FILTER (o_orderkey % 3 = 0) AS sent, count(*) FILTER (o_orderkey % 3 <> 0) AS failed FROM d
""")
def dispatch_counts(spark, sf_dir):
    q = _queue(spark, sf_dir)
    return lifecycle.dispatch_counts(q, q.where("cast(token as long) % 3 = 0").select("token"), _users(spark, sf_dir), _time("1996-01-01 00:00:00"))


@query("""
WITH p AS (SELECT event_id, user_id AS company_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 600)::INT END AS code FROM events)
SELECT company_id, count(*) * 2 AS probes, 2 * count(*) FILTER (code BETWEEN 200 AND 399) AS alive FROM p GROUP BY company_id
""")
def probe_log(spark, sf_dir):
    i = F.col("event_id")
    found = load(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.when(i % 4 != 0, (i % 600).cast("int")).alias("status_code"), F.lit(None).cast("string").alias("error"))
    none = found.select("company_id", _time("2024-01-01 00:00:00").alias("probed_at"), "status_code", F.lit(False).alias("alive"), "error").where("false")
    log = lifecycle.probes_recorded(lifecycle.probes_recorded(none, found, _time("2024-01-01 00:00:00")), found, _time("2024-02-01 00:00:00"))
    return log.groupBy("company_id").agg(F.count("*").alias("probes"), F.count_if("alive").alias("alive"))


@query(f"""
WITH {GRAPH}, n AS (SELECT source AS id, s_name FROM e)
SELECT source, target, relation, 'a|b' AS origins FROM e UNION ALL SELECT source, 'SEGMENT:x', 'IN', 'b' FROM e
""")
def graph_merged_edges(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    more = edges.unionByName(edges.select("source", F.lit("SEGMENT:x").alias("target"), F.lit("IN").alias("relation")))
    out = graph.merged_edges([graph.with_origin(edges, "a"), graph.with_origin(more.unionByName(more), "b")])
    return out.withColumn("origins", F.array_join("origins", "|"))


@query(f"""
WITH {GRAPH} SELECT source AS id, 'company' AS type, s_name || ' & <co>' AS name FROM e UNION ALL SELECT DISTINCT target, 'unknown', target FROM e UNION ALL SELECT 'NEW:' || source, 'new', s_name FROM e
""")
def graph_integrated(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    blank = nodes.withColumn("name", F.when(F.col("type") == "company", "").otherwise(F.col("name")))
    own = F.col("type") == "company"
    new = nodes.unionByName(nodes.where(own).select(F.concat(F.lit("NEW:"), "id").alias("id"), F.lit("new").alias("type"), F.regexp_replace("name", " & <co>$", "").alias("name")))
    merged, _ = graph.integrated(blank, edges, new, edges)
    return merged


@query(f"""
WITH {GRAPH} SELECT 'node' AS kind, 'company' AS key, count(*) AS n FROM e UNION ALL SELECT 'node', 'unknown', count(DISTINCT target) FROM e UNION ALL SELECT 'edge', relation, count(*) FROM e GROUP BY relation
""")
def graph_summary(spark, sf_dir):
    return graph.summary(*_graph(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT 'type' AS how, source AS id FROM e UNION ALL SELECT 'edge', source FROM e UNION ALL SELECT DISTINCT 'edge', target FROM e")
def graph_select(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    a = graph.selected_nodes(nodes, "type", ["company", "none"]).select(F.lit("type").alias("how"), "id")
    return a.unionByName(graph.selected_by_edges(nodes, edges, "relation", ["BASED_IN"]).select(F.lit("edge").alias("how"), "id"))


@query("""
WITH m AS (SELECT l_orderkey AS q, l_linenumber AS r, s_name, CASE l_linenumber % 4 WHEN 0 THEN 'dead' WHEN 1 THEN 'acquired' WHEN 2 THEN 'operating' ELSE 'unknown' END AS o, l_quantity > 25 AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT DISTINCT 'USER:' || q AS source, 'COMPANY:' || s_name AS target, CASE WHEN o = 'dead' AND c THEN 'RESEMBLES_DEAD_CLONE' WHEN o = 'dead' THEN 'RESEMBLES_DEAD' WHEN o = 'acquired' THEN 'RESEMBLES_ACQUIRED' WHEN o = 'operating' THEN 'RESEMBLES_OPERATING' ELSE 'RESEMBLES' END AS relation FROM m WHERE r <= 5
UNION ALL SELECT 'USER:' || c_custkey, 'CONCERN:' || x, 'CONCERNED_ABOUT' FROM (SELECT c_custkey, unnest(list_distinct(['Lack of Funds', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Lack of Funds' END])) AS x FROM customer)
""")
def graph_user_edges(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    named = nodes.where("type = 'company'").withColumn("name", F.regexp_replace("name", " & <co>$", ""))
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    k = F.col("l_linenumber") % 4
    matches = rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("final_rank"), F.upper("s_name").alias("match"), F.when(k == 0, "dead").when(k == 1, "acquired").when(k == 2, "operating").otherwise("unknown").alias("outcome"), (F.col("l_quantity") > 25).alias("convergence"))
    met = graph.nodes_by_name(matches, "match", named)
    edges = graph.resemblance_edges(met, F.concat(F.lit("USER:"), F.col("query_id").cast("string")), F.col("id"), 5).distinct()
    asked = load(spark, sf_dir, "customer").select("c_custkey", F.lit("Lack of Funds").alias("main_concern"), F.array(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("Lack of Funds"), F.lit("")).alias("secondary_concerns"))
    return edges.unionByName(graph.concern_edges(asked, F.concat(F.lit("USER:"), F.col("c_custkey").cast("string"))))


@query("SELECT c_custkey, lower(c_mktsegment) || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer)")
def unique_slugs(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("slug"))
    return linkage.with_suffix_on_collision(rows, "slug", ["c_custkey"], "id").select("c_custkey", "id")


@query("""
WITH d AS (SELECT row, l_orderkey, l_linenumber, unnest([{'n': 'a', 'p': l_quantity}, {'n': 'b', 'p': l_discount * 400}, {'n': 'c', 'p': 20.0}, {'n': 'd', 'p': l_tax * 500}], recursive := true) FROM (SELECT *, row_number() OVER () AS row FROM lineitem)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY p DESC, n) AS k FROM d)
SELECT l_orderkey, l_linenumber, array_to_string(list(n ORDER BY k) FILTER (k <= 3), '|') AS reasons FROM r GROUP BY row, l_orderkey, l_linenumber
""")
def strongest_dimensions(spark, sf_dir):
    dim = lambda name, p: F.struct(F.lit(name).alias("name"), F.lit(1.0).alias("value"), p.cast("double").alias("points"))
    dims = F.array(dim("a", F.col("l_quantity")), dim("b", F.col("l_discount") * 400), dim("c", F.lit(20.0)), dim("d", F.col("l_tax") * 500))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(scoring.explain(dims), "|").alias("reasons"))


@query("""
WITH r AS (UNPIVOT (SELECT count(*) AS total, count(nullif(trim(text), '')) AS text, count(nullif(trim(lang), '')) AS lang FROM documents) ON text, lang INTO NAME field VALUE filled)
SELECT field, format('{:<24} {:>8d} / {:>8d}  {:>6.2f} %', field, filled, total, floor(filled / total * 10000 + 0.5) / 100) AS line,
  '{"field":"' || field || '","filled":' || filled || ',"total":' || total || '}' AS value FROM r
""")
def report_lines(spark, sf_dir):
    rates = quality.fill_rates(load(spark, sf_dir, "documents"), ["text", "lang"])
    return quality.report_text(rates).join(quality.report_json(rates.drop("rate"), "field"), "field")


@query("SELECT c_custkey % 50 AS k, CASE WHEN count(*) FILTER (c_custkey % 3 = 0) > 0 THEN 'Inactive' ELSE 'Active' END AS status, array_to_string(list_sort(list(DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'Dissolved' ELSE 'Active' END)), '|') AS statuses FROM customer GROUP BY c_custkey % 50")
def dissolved_wins(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("k"), F.when(F.col("c_custkey") % 3 == 0, "Dissolved").otherwise("Active").alias("status"))
    return linkage.status_upgrade(rows, "k").withColumn("statuses", F.array_join("statuses", "|"))


@query("SELECT n_nationkey, coalesce(array_to_string((SELECT list_sort(list(DISTINCT c_mktsegment)) FROM customer WHERE c_nationkey = n_nationkey), '|'), '') AS pages FROM nation")
def taxonomy_join(spark, sf_dir):
    pages = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("name"))
    return linkage.multi_match(load(spark, sf_dir, "nation").select("n_nationkey"), pages, "n_nationkey", "pages").withColumn("pages", F.array_join("pages", "|"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 OR vec_id % 5 = 0 THEN 'new' ELSE 'kept' END AS state FROM embeddings")
def vector_validity(spark, sf_dir):
    """Vectors made of texts that have changed, or that were never made, are asked for again."""
    rows = load(spark, sf_dir, "embeddings")
    corpus = rows.select("vec_id", F.concat(F.lit("text "), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 3 == 0, "!").otherwise("")).alias("text"))
    stored = rows.where("vec_id % 5 <> 0").select("vec_id", "embedding", F.xxhash64(F.concat(F.lit("text "), F.col("vec_id").cast("string"))).alias("text_hash"))
    path = sinks.scratch(spark, "tables")
    sinks.write_tables({"vectors": stored}, path)
    valid, new = sinks.fresh_vectors(corpus, spark.read.parquet(f"{path}/vectors"), "vec_id")
    return valid.select("vec_id", F.lit("kept").alias("state")).unionByName(new.select("vec_id", F.lit("new").alias("state")))
