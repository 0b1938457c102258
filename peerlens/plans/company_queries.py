"""Queries over companies: keys, merges, upserts, classification, cohorts, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.functions import text as tx
from peerlens.operators import cohorts, linkage, scoring, vectors

from .analogs import ASKED, COMPANIES, companies, round4
from .registry import load, query, values


@query(r"""
WITH n AS (SELECT c_custkey AS id, c_name || CASE c_custkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' S.A.' ELSE '' END AS name FROM customer
  UNION ALL SELECT -s_suppkey, s_name || ' Co' FROM supplier),
k AS (SELECT id, name, regexp_replace(lower(trim(name)), '\b(limited|gmbh|corp|s\.a\.|srl|llc|ltd|plc|inc|s\.a|co|sa|bv|ag|oy|ab)\b\.?', '', 'g') AS bare FROM n)
SELECT id, regexp_replace(regexp_replace(bare, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS entity_key, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS compact,
  coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'anon') AS slug FROM k
""")
def entity_key(spark, sf_dir):
    suffix = F.when(F.col("id") % 4 == 0, " Inc.").when(F.col("id") % 4 == 1, " GmbH").when(F.col("id") % 4 == 2, " S.A.").otherwise("")
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).withColumn("name", F.concat("name", suffix))
    b = load(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), F.concat("s_name", F.lit(" Co")).alias("name"))
    rows = a.unionByName(b)
    return rows.select("id", tx.entity_key(F.col("name")).alias("entity_key"), tx.compact_key(F.col("name")).alias("compact"), tx.slug(F.col("name")).alias("slug"))


ALIASES = {"united states": "usa", "united kingdom": "uk", "saudi arabia": "ksa", "russia": "russian federation"}


@query(f"""
WITH a(k, v) AS (VALUES {values(list(ALIASES.items()))}), n AS (SELECT n_nationkey, regexp_replace(lower(trim(n_name)), '[^\\w\\s]', '', 'g') AS b FROM nation)
SELECT n_nationkey, coalesce(v, b) AS country FROM n LEFT JOIN a ON k = b
""")
def country_alias(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", tx.country_key(F.col("n_name"), ALIASES).alias("country"))


def _sources(spark, sf_dir):
    """Customers and suppliers as two sources that share keys by number."""
    a = load(spark, sf_dir, "customer").select(F.lit("crm").alias("source"), F.lit(0).alias("source_ord"), F.col("c_custkey").alias("record_ord"), (F.col("c_custkey") % 500).cast("string").alias("norm"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.array(F.col("c_mktsegment")).alias("categories"))
    b = load(spark, sf_dir, "supplier").select(F.lit("erp").alias("source"), F.lit(1).alias("source_ord"), F.col("s_suppkey").alias("record_ord"), F.col("s_suppkey").cast("string").alias("norm"), F.col("s_name").alias("name"), F.array(F.lit("SUPPLY"), F.lit("")).alias("categories"))
    return a.unionByName(b)


SOURCES = """src AS (
  SELECT 'crm' AS source, 0 AS source_ord, c_custkey AS record_ord, (c_custkey % 500)::VARCHAR AS norm, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, [c_mktsegment] AS categories FROM customer
  UNION ALL SELECT 'erp', 1, s_suppkey, s_suppkey::VARCHAR, s_name, ['SUPPLY', ''] FROM supplier)"""


@query(f"WITH {SOURCES} SELECT norm, arg_min(name, (source_ord, record_ord)) FILTER (nullif(trim(name), '') IS NOT NULL) AS name, count(*) AS records FROM src GROUP BY norm")
def merge_first_wins(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    merged = linkage.merge_records(rows, ["name"], ["categories"])
    return merged.join(rows.groupBy("norm").agg(F.count("*").alias("records")), "norm").select("norm", "name", "records")


@query(f"""
WITH {SOURCES}, i AS (SELECT norm, x, min((source_ord, record_ord)) AS o FROM (SELECT norm, source_ord, record_ord, unnest(categories) AS x FROM src) WHERE nullif(trim(x), '') IS NOT NULL GROUP BY norm, x)
SELECT norm, array_to_string(list(x ORDER BY o), '|') AS categories, (SELECT array_to_string(list(s ORDER BY s), '|') FROM (SELECT DISTINCT source AS s FROM src b WHERE b.norm = i.norm)) AS sources FROM i GROUP BY norm
""")
def merge_list_union(spark, sf_dir):
    merged = linkage.merge_records(_sources(spark, sf_dir), ["name"], ["categories"])
    return merged.select("norm", F.array_join("categories", "|").alias("categories"), F.array_join("sources", "|").alias("sources"))


@query(f"WITH {SOURCES} SELECT norm, source, trim(name) AS value, count(*) AS n FROM src WHERE nullif(trim(name), '') IS NOT NULL GROUP BY ALL")
def provenance_log(spark, sf_dir):
    merged = linkage.merge_records(_sources(spark, sf_dir), ["name"])
    return merged.select("norm", F.explode(F.element_at("provenance", F.lit("name"))).alias("e")).select("norm", "e.source", "e.value", "e.n")


HOT = """hot AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE 'k' || l_suppkey END AS norm, 'm' || (l_partkey % 7) AS source, l_partkey AS source_ord, l_linenumber AS record_ord, l_orderkey AS id, round(l_extendedprice * 100)::BIGINT AS amount,
    CASE WHEN l_linenumber > 1 THEN l_returnflag || l_linestatus END AS status, CASE WHEN l_linenumber > 2 THEN ' p' || (l_suppkey % 10) ELSE ' ' END AS place, [l_returnflag, NULL, 'm' || (l_partkey % 7), ''] AS tags FROM lineitem)"""


def _hot(spark, sf_dir):
    """Line items as records of entities, of which one has a third of all rows."""
    i, n, source = F.col("l_orderkey"), F.col("l_linenumber"), F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string"))
    return load(spark, sf_dir, "lineitem").select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("l_suppkey").cast("string"))).alias("norm"), source.alias("source"), F.col("l_partkey").alias("source_ord"), n.alias("record_ord"), i.alias("id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"),
        F.when(n > 1, F.concat("l_returnflag", "l_linestatus")).alias("status"), F.when(n > 2, F.concat(F.lit(" p"), (F.col("l_suppkey") % 10).cast("string"))).otherwise(" ").alias("place"), F.array("l_returnflag", F.lit(None).cast("string"), source, F.lit("")).alias("tags"),
    )


@query(f"""
WITH {HOT}, f AS (SELECT *, (source_ord, record_ord, id, amount) AS o FROM hot),
a AS (SELECT norm, arg_min(status, o) FILTER (status IS NOT NULL) AS status, arg_min(trim(place), o) FILTER (nullif(trim(place), '') IS NOT NULL) AS place FROM f GROUP BY norm),
t AS (SELECT norm, array_to_string(list(x ORDER BY o), '|') AS tags FROM (SELECT norm, x, min((source_ord, record_ord, id, amount, CASE WHEN x = source THEN 1 ELSE 0 END)) AS o FROM (SELECT norm, source, source_ord, record_ord, id, amount, unnest(tags) AS x FROM hot) WHERE nullif(trim(x), '') IS NOT NULL GROUP BY norm, x) GROUP BY norm),
s AS (SELECT norm, array_to_string(list(source ORDER BY o), '|') AS sources FROM (SELECT norm, source, min(o) AS o FROM f GROUP BY norm, source) GROUP BY norm),
p AS (SELECT norm, count(*) AS facts FROM (SELECT DISTINCT norm, source, status FROM hot WHERE status IS NOT NULL UNION ALL SELECT DISTINCT norm, source, place FROM hot WHERE nullif(trim(place), '') IS NOT NULL) GROUP BY norm)
SELECT norm, status, place, tags, sources, coalesce(facts, 0) AS facts FROM a JOIN t USING (norm) JOIN s USING (norm) LEFT JOIN p USING (norm)
""")
def merge_hot_entity(spark, sf_dir):
    merged = linkage.merge_records(_hot(spark, sf_dir), ["status", "place"], ["tags"], order=("source_ord", "record_ord", "id", "amount"))
    n = F.aggregate(F.map_values("provenance"), F.lit(0).cast("long"), lambda a, x: a + F.size(x))
    return merged.select("norm", "status", "place", F.array_join("tags", "|").alias("tags"), F.array_join("sources", "|").alias("sources"), n.alias("facts"))


@query(f"""
WITH {HOT}, r AS (SELECT norm, source, arg_max({{'id': id, 'status': status, 'n': record_ord}}, (source_ord, record_ord, id, amount)) AS r, count(*) AS records FROM hot GROUP BY norm, source)
SELECT norm, source, r.id AS id, r.status AS status, r.n AS record_ord, records FROM r
""")
def records_of_sources(spark, sf_dir):
    """The last record of each source and entity, read back from its VARIANT."""
    kept = linkage.raw_per_source(_hot(spark, sf_dir), order=("source_ord", "record_ord", "id", "amount"))
    get = lambda path, kind: F.try_variant_get("raw", path, kind)
    return kept.select("norm", "source", get("$.id", "long").alias("id"), get("$.status", "string").alias("status"), get("$.record_ord", "int").alias("record_ord"), "records")


@query("""
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'dead' END AS outcome FROM customer),
s AS (SELECT s_suppkey AS k, s_name AS name, 'operating' AS outcome FROM supplier)
SELECT coalesce(c.k, s.k) AS k, coalesce(c.name, s.name) AS name, CASE WHEN coalesce(c.outcome, 'unknown') = 'unknown' THEN coalesce(s.outcome, c.outcome) ELSE c.outcome END AS outcome FROM c FULL JOIN s ON c.k = s.k
""")
def upsert_fill_empty(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 5 == 0, "unknown").otherwise("dead").alias("outcome"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("operating").alias("outcome"))
    return linkage.upsert(c, s, "k", {"name": "fill", "outcome": "outcome"})


@query("""
WITH a AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id + 1 AS doc_id, text FROM documents)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN length(coalesce(b.text, '')) > length(coalesce(a.text, '')) THEN length(b.text) ELSE length(a.text) END AS kept_chars FROM a FULL JOIN b ON a.doc_id = b.doc_id
""")
def upsert_longest_text(spark, sf_dir):
    a = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = linkage.upsert(a, a.withColumn("doc_id", F.col("doc_id") + 1), "doc_id", {"text": "longest"})
    return out.select("doc_id", F.length("text").cast("long").alias("kept_chars"))


@query("SELECT min(doc_id) AS doc_id, text, count(*) AS copies FROM documents GROUP BY text")
def dedupe_keep_first(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    # copies meet in a combined aggregation: a text that fills a third of the table is no hot window
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""
SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest_status, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year,
  array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities FROM orders GROUP BY o_custkey
""")
def rollup_latest_name(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest_status"),
        F.min(F.year("o_orderdate")).alias("first_year"),
        F.max(F.year("o_orderdate")).alias("last_year"),
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"),
    )


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS segment FROM orders)
SELECT o_orderkey, coalesce(segment, c_mktsegment) AS segment FROM o LEFT JOIN customer ON c_custkey = o_custkey
""")
def lookup_fill(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("segment"))
    lookup = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return linkage.fill_from_lookup(orders, lookup, "k", ["segment"]).select("o_orderkey", "segment")


PATCHES = [(3, "PATCHED A"), (11, "PATCHED B"), (-5, "NOBODY")]


@query(f"""
WITH p(k, seg) AS (VALUES {values(PATCHES)})
SELECT 'row' AS kind, c_custkey AS k, coalesce(seg, c_mktsegment) AS segment FROM customer LEFT JOIN p ON k = c_custkey
UNION ALL SELECT 'miss', k, seg FROM p WHERE k NOT IN (SELECT c_custkey FROM customer)
""")
def curated_patch_anti(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    patches = spark.createDataFrame(PATCHES, "k long, segment string")
    done, misses = linkage.apply_patches(rows, patches, "k", ["segment"])
    return done.select(F.lit("row").alias("kind"), "k", "segment").unionByName(misses.select(F.lit("miss").alias("kind"), "k", "segment"))


@query("SELECT o_custkey AS k, count(*) AS orders FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY o_custkey")
def rows_unseen_anti(spark, sf_dir):
    seen = load(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return linkage.unseen(load(spark, sf_dir, "orders"), seen, "o_orderkey").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))


@query(f"WITH {COMPANIES} SELECT company_id, status, outcome, outcome = 'dead' AS dead FROM company")
def outcome_bucket(spark, sf_dir):
    return companies(spark, sf_dir).select("company_id", "status", "outcome", cl.is_dead(F.col("status")).alias("dead"))


MACROS = {"metals": ["steel", "brass", "copper", "tin", "nickel"], "finish": ["polished", "plated", "brushed", "burnished", "anodized"], "size": ["large", "small", "medium", "economy"], "plain": ["standard"]}


@query(f"""
WITH k(macro, kw) AS (VALUES {values([(m, w) for m, ws in MACROS.items() for w in ws])}),
c AS (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS cat FROM part)
SELECT p_partkey, array_to_string(list_sort(list(DISTINCT macro)), '|') AS macros FROM c JOIN k ON contains(cat, kw) OR contains(kw, cat) WHERE cat <> '' GROUP BY p_partkey
""")
def macro_expand(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", cl.categories_to_macros(F.split("p_type", " "), MACROS).alias("m"))
    return rows.where(F.size("m") > 0).select("p_partkey", F.array_join("m", "|").alias("macros"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'Inactive' WHEN o_orderstatus = 'F' THEN 'Acquired' WHEN o_orderstatus = 'P' THEN 'Suspended' ELSE 'Active' END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'dead' WHEN o_orderstatus = 'F' THEN 'acquired' WHEN o_orderstatus = 'P' THEN 'distressed' ELSE 'operating' END AS source_outcome FROM orders
""")
def status_classifier(spark, sf_dir):
    s, urgent = F.col("o_orderstatus"), F.col("o_orderpriority").startswith("1")
    found = (
        F.when((s == "F") & urgent, F.struct(F.lit("Inactive"), F.lit("dead")))
        .when(s == "F", F.struct(F.lit("Acquired"), F.lit("acquired")))
        .when(s == "P", F.struct(F.lit("Suspended"), F.lit("distressed")))
        .otherwise(F.struct(F.lit("Active"), F.lit("operating")))
    )
    return load(spark, sf_dir, "orders").select("o_orderkey", found["col1"].alias("status"), found["col2"].alias("source_outcome"))


@query(f"WITH {COMPANIES} SELECT company_id, founded_year, decade, (shutdown_year // 10 * 10)::INT::VARCHAR || 's' AS end_decade, founded_year AS parsed FROM company")
def year_decade(spark, sf_dir):
    c = companies(spark, sf_dir)
    return c.select("company_id", "founded_year", "decade", cl.decade(F.col("shutdown_year")).alias("end_decade"), cl.leading_year(F.concat(F.lit(" "), F.col("founded_year").cast("string"), F.lit("-01"))).alias("parsed"))


_BAND = "CASE " + " ".join(f"WHEN m BETWEEN {a} AND {b} THEN {v}" for a, b, v in lx.HEADCOUNT_BANDS) + " END"


@query(f"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size::VARCHAR || ' - ' || (p_size * 20)::VARCHAR ELSE 'about ' || (p_size * 300)::VARCHAR END AS s FROM part),
n AS (SELECT p_partkey, list_transform(regexp_extract_all(replace(lower(s), ' ', ''), '[0-9]+'), lambda x: x::BIGINT) AS x FROM t),
b AS (SELECT p_partkey, CASE WHEN len(x) = 1 THEN x[1] ELSE (x[1] + x[-1]) // 2 END AS m FROM n),
h AS (SELECT p_partkey, CASE WHEN m > 10000 THEN 9 ELSE {_BAND} END AS band FROM b)
SELECT p_partkey, band::INT AS band, least(8, greatest(0, band - 1))::INT AS implicit_stage FROM h
""")
def headcount_bucket(spark, sf_dir):
    size = F.col("p_size").cast("string")
    s = F.when(F.col("p_partkey") % 3 == 0, size).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit(" - "), (F.col("p_size") * 20).cast("string"))).otherwise(F.concat(F.lit("about "), (F.col("p_size") * 300).cast("string")))
    return load(spark, sf_dir, "part").select("p_partkey", cl.headcount_band(s).alias("band"), cl.implicit_stage(s).alias("implicit_stage"))


LABELS = {"1-URGENT": "Series A", "2-HIGH": "late stage round", "3-MEDIUM": " Pre-Seed ", "4-NOT SPECIFIED": "", "5-LOW": "other"}


@query(f"""
WITH m(p, s) AS (VALUES {values(list(LABELS.items()))}), st(name, v) AS (VALUES {values(lx.STAGES)}), o(name, k) AS (VALUES {values([(n, i) for i, (n, _) in enumerate(lx.STAGES)])}),
x AS (SELECT p, lower(trim(s)) AS s FROM m),
e AS (SELECT p, s, (SELECT v FROM st WHERE name = s) AS exact, (SELECT arg_min(v, k) FROM st JOIN o USING (name) WHERE contains(s, name)) AS inside FROM x)
SELECT o_orderkey, (CASE WHEN s <> '' THEN coalesce(exact, inside) END)::INT AS stage FROM orders JOIN e ON p = o_orderpriority
""")
def stage_ordinal(spark, sf_dir):
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("o_orderpriority"))
    return load(spark, sf_dir, "orders").select("o_orderkey", cl.stage_ordinal(label).alias("stage"))


PEERS = f"""{COMPANIES},
cell AS (SELECT category AS macro, decade, country, shutdown_year, count(*) AS n FROM company WHERE outcome = 'dead' GROUP BY ALL),
near AS (SELECT *, sum(n) OVER (PARTITION BY macro, decade, country ORDER BY shutdown_year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, sum(n) OVER (PARTITION BY macro, decade, country) AS size FROM cell),
peers AS (SELECT company_id, coalesce(near - 1, 0)::BIGINT AS peers_co_dying, coalesce(size, 0)::BIGINT AS cohort_size
  FROM company c LEFT JOIN near n ON c.outcome = 'dead' AND n.macro = c.category AND n.decade = c.decade AND n.country = c.country AND n.shutdown_year = c.shutdown_year)"""


def _with_macros(spark, sf_dir):
    return companies(spark, sf_dir).withColumns({"macros": F.array("category"), "categories": F.array("category"), "founders": F.when(F.col("company_id") % 3 == 0, F.array(F.lit("one"))).otherwise(F.array(F.lit("one"), F.lit("two")))})


@query(f"WITH {PEERS} SELECT * FROM peers")
def cohort_collapse(spark, sf_dir):
    return cohorts.with_cohort_peers(_with_macros(spark, sf_dir)).select("company_id", "peers_co_dying", "cohort_size")


_LIFE = "CASE " + " ".join(f"WHEN span >= {a} AND span < {b} THEN '{n}'" for a, b, n in lx.LIFESPAN_BANDS) + " END"


@query(f"""
WITH {PEERS}, x AS (SELECT company_id, shutdown_year - founded_year AS span, outcome, peers_co_dying FROM company JOIN peers USING (company_id)),
l AS (SELECT company_id, span, list_filter([{_LIFE}, CASE WHEN company_id % 3 = 0 THEN 'solo_founder' END, CASE WHEN outcome = 'acquired' AND span < 3 THEN 'acqui_hire' END, CASE WHEN peers_co_dying >= 10 THEN 'cohort_collapse' END], lambda v: v IS NOT NULL) AS labels FROM x)
SELECT company_id, span::INT AS lifespan_years, array_to_string(labels, '|') AS labels, CASE WHEN len(labels) = 0 THEN NULL WHEN len(labels) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM l
""")
def failure_pattern(spark, sf_dir):
    out = cohorts.failure_pattern(cohorts.with_cohort_peers(_with_macros(spark, sf_dir)))
    return out.select("company_id", "lifespan_years", F.array_join("pattern_labels", "|").alias("labels"), F.col("pattern_confidence").alias("confidence"))


CELLS = f"""{COMPANIES},
cells AS (SELECT category AS macro, decade, count(*) FILTER (outcome = 'operating') AS operating, count(*) FILTER (outcome = 'acquired') AS acquired, count(*) FILTER (outcome = 'dead') AS dead, count(*) FILTER (outcome = 'unknown') AS unknown, count(*) AS total, grouping(category) * 2 + grouping(decade) AS level
  FROM company GROUP BY ROLLUP (category, decade)),
rates AS (SELECT *, {round4('(operating + acquired) / greatest(total, 1)')} AS survival_rate, {round4('dead / greatest(total, 1)')} AS death_rate FROM cells)"""


@query(f"WITH {CELLS} SELECT macro, decade, operating, acquired, dead, unknown, total, level::BIGINT AS level, survival_rate, death_rate FROM rates")
def cohort_survival(spark, sf_dir):
    return cohorts.cohort_survival(_with_macros(spark, sf_dir))


@query(f"WITH {CELLS} SELECT macro, decade, total, survival_rate, {round4('survival_rate - lag(survival_rate) OVER (PARTITION BY macro ORDER BY decade)')} AS delta FROM rates WHERE level = 0 AND total >= 10 AND decade <> 'unknown'")
def cohort_lookup(spark, sf_dir):
    return cohorts.comparison_decades(cohorts.cohort_survival(_with_macros(spark, sf_dir)), 10)


@query("SELECT p_brand AS category, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, min(p_partkey) LIMIT 15")
def top_categories(spark, sf_dir):
    return cohorts.top_values(load(spark, sf_dir, "part").withColumn("category", F.col("p_brand")), "category", 15, "p_partkey")
