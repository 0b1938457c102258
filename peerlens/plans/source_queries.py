"""Queries that send the driver's tables, in the shape of the sources' records, through adapters, page parsers and sinks."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from peerlens.functions import lexicons as lx
from peerlens.operators import graph, linkage
from peerlens.sources import adapters, html, sinks, versions

from .function_queries import _KEY
from .registry import load, query

REGISTER = """raw AS (SELECT c_custkey AS id, '12.345.678/' || lpad(c_custkey::VARCHAR, 6, '0') AS cnpj, c_name AS social, CASE WHEN c_custkey % 4 = 0 THEN 'Brand ' || c_custkey ELSE ' ' END AS comerc,
  CASE c_custkey % 3 WHEN 0 THEN 'ATIVO' WHEN 1 THEN 'CANCELADA' ELSE 'SUSPENSO' END AS sit, CASE c_custkey % 5 WHEN 0 THEN 'INCORPORAÇÃO' WHEN 1 THEN 'FALÊNCIA' ELSE '' END AS motivo,
  CASE c_custkey % 7 WHEN 0 THEN 'EM RECUPERAÇÃO JUDICIAL' ELSE 'FASE OPERACIONAL' END AS emissor, (1950 + c_custkey % 70) || '-02-03' AS const, CASE WHEN c_custkey % 3 = 1 THEN (2000 + c_custkey % 20) || '-05-06' END AS cancel,
  CASE c_custkey % 4 WHEN 0 THEN 'BANCOS E SEGUROS' WHEN 1 THEN '' ELSE c_mktsegment END AS setor, n_name AS mun FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _register(spark, sf_dir):
    k, at = F.col("c_custkey"), lambda n: F.col("c_custkey") % n
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(
        F.concat(F.lit("12.345.678/"), F.lpad(k.cast("string"), 6, "0")).alias("CNPJ_CIA"), F.col("c_name").alias("DENOM_SOCIAL"),
        F.when(at(4) == 0, F.concat(F.lit("Brand "), k.cast("string"))).otherwise(" ").alias("DENOM_COMERC"),
        F.when(at(3) == 0, "ATIVO").when(at(3) == 1, "CANCELADA").otherwise("SUSPENSO").alias("SIT"),
        F.when(at(5) == 0, "INCORPORAÇÃO").when(at(5) == 1, "FALÊNCIA").otherwise("").alias("MOTIVO_CANCEL"),
        F.when(at(7) == 0, "EM RECUPERAÇÃO JUDICIAL").otherwise("FASE OPERACIONAL").alias("SIT_EMISSOR"),
        F.concat((1950 + at(70)).cast("string"), F.lit("-02-03")).alias("DT_CONST"),
        F.when(at(3) == 1, F.concat((2000 + at(20)).cast("string"), F.lit("-05-06"))).alias("DT_CANCEL"),
        F.when(at(4) == 0, "BANCOS E SEGUROS").when(at(4) == 1, "").otherwise(F.col("c_mktsegment")).alias("SETOR_ATIV"), F.col("n_name").alias("MUN"),
    )


_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"""
WITH {REGISTER}, n AS (SELECT *, coalesce(nullif(trim(comerc), ''), social) AS name FROM raw)
SELECT name, {_KEY.format("name")} AS norm, regexp_replace(cnpj, '[^0-9]', '', 'g') AS cnpj,
  CASE WHEN motivo = 'INCORPORAÇÃO' OR motivo = 'FALÊNCIA' THEN 'Inactive' WHEN id % 7 = 0 THEN 'Active' WHEN sit IN ('CANCELADA', 'SUSPENSO') THEN 'Inactive' ELSE 'Active' END AS status,
  CASE WHEN motivo = 'INCORPORAÇÃO' THEN 'acquired' WHEN motivo = 'FALÊNCIA' THEN 'dead' WHEN id % 7 = 0 THEN 'distressed' WHEN sit IN ('CANCELADA', 'SUSPENSO') THEN 'dormant' ELSE 'operating' END AS outcome,
  CASE WHEN motivo = 'FALÊNCIA' THEN 'Lack of Funds' END AS failure_cause, left(const, 4) AS founded_year, left(cancel, 4) AS shutdown_year,
  CASE WHEN setor = '' THEN '' WHEN contains(setor, 'BANCO') THEN 'Banking' WHEN setor = 'AUTOMOBILE' THEN {_TITLE.format('setor')} ELSE {_TITLE.format('setor')} END AS category,
  'Companhia aberta brasileira registrada na CVM. Setor: ' || coalesce(nullif(setor, ''), 'n/d') || '. Situação: ' || sit || ' (' || emissor || ').' || CASE WHEN motivo <> '' THEN ' Motivo de cancelamento: ' || motivo || '.' ELSE '' END AS description FROM n
""")
def register_records(spark, sf_dir):
    rows = adapters.register_records(_register(spark, sf_dir))
    return rows.select("name", "norm", "cnpj", "status", "outcome", "failure_cause", "founded_year", "shutdown_year", F.array_join("categories", "|").alias("category"), "description")


@query(f"""
WITH {REGISTER}, n AS (SELECT *, coalesce(nullif(trim(comerc), ''), social) AS name FROM raw)
SELECT name, {_KEY.format("name")} AS norm, left(const, 4) AS founded_year, mun AS city FROM n
""")
def register_file(spark, sf_dir):
    """Written in Latin-1 with semicolons, and read back by the adapter."""
    path = sinks.scratch(spark, "register")
    _register(spark, sf_dir).write.csv(path, sep=";", encoding="ISO-8859-1", header=True, lineSep="\n")
    return adapters.ADAPTERS["register"](spark, path).select("name", "norm", "founded_year", "city")


@query("""
WITH h AS (SELECT l_suppkey AS k, s_name AS name, year(l_shipdate)::INT AS y, CASE l_linenumber % 3 WHEN 0 THEN 'SIDERURGIA' WHEN 1 THEN 'Outra Coisa' ELSE '' END AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'ABERTA' ELSE 'FECHADA' END AS a
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
g AS (SELECT name, min(y) AS y0, max(y) AS y1, list_sort(list(DISTINCT s) FILTER (s <> '')) AS ss, arg_max(a, (y, a)) AS listed FROM h GROUP BY name)
SELECT name, 'Empresa brasileira com participação acionária da BNDESPar. Ativa no portfólio de ' || y0 || ' a ' || y1 || '. Setor(es): ' || coalesce(nullif(array_to_string(ss, ', '), ''), 'não especificado') || '. Tipo: ' || CASE listed WHEN 'ABERTA' THEN 'listada em bolsa' ELSE 'companhia fechada' END || '.' AS description,
  array_to_string(list_transform(ss, lambda s: CASE s WHEN 'SIDERURGIA' THEN 'Steel' ELSE s END), '|') AS categories FROM g
""")
def holding_records(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    n = F.col("l_linenumber")
    raw = rows.select(F.lit(None).cast("string").alias("cnpj"), F.col("s_name").alias("razao_social"), F.year("l_shipdate").cast("string").alias("ano"), F.when(n % 3 == 0, "SIDERURGIA").when(n % 3 == 1, "Outra Coisa").otherwise("").alias("setor_de_atividade"), F.when(n % 2 == 0, "ABERTA").otherwise("FECHADA").alias("aberta_fechada"))
    return adapters.holding_records(raw).select("name", "description", F.array_join("categories", "|").alias("categories"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand, p_type, p_size FROM part)
SELECT name, 'about ' || p_type AS description, (2000 + id % 24)::VARCHAR AS founded_year, 'W' || lpad((id % 24)::VARCHAR, 2, '0') AS batch, p_size::VARCHAR AS headcount, 'France' AS country, 'Paris' AS city,
  'B2B|' || p_brand || '|Ops' AS categories FROM p
""")
def accelerator_records(spark, sf_dir):
    i = F.col("p_partkey")
    hits = load(spark, sf_dir, "part").select(
        i.alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("about "), F.col("p_type")).alias("one_liner"), F.lit(" ").alias("long_description"), F.concat(F.lit("W"), F.lpad((i % 24).cast("string"), 2, "0")).alias("batch"), F.lit("Active").alias("status"),
        F.col("p_size").alias("team_size"), F.lit("Paris, France; Remote").alias("all_locations"), F.lit("x.io").alias("website"), F.array(F.lit("B2B")).alias("industries"), F.array("p_brand", F.lit("b2b")).alias("tags"), F.lit("b2b").alias("industry"), F.lit("B2B -> Ops").alias("subindustry"),
    )
    out = adapters.accelerator_records(hits.unionByName(hits))
    return out.select("name", "description", "founded_year", F.col("yc_batch").alias("batch"), "headcount", "country", "city", F.array_join("categories", "|").alias("categories"))


@query("""
WITH s AS (SELECT s_suppkey AS id, s_name AS name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT name, (1900 + id % 100)::VARCHAR AS founded_year, CASE WHEN id % 3 = 0 THEN '2005' END AS shutdown_year, CASE WHEN id % 3 = 0 THEN 'Inactive' ELSE 'Active' END AS status, 'Atlantis' AS country, 'steel|iron' AS categories,
  'https://www.wikidata.org/wiki/Q' || id AS link FROM s WHERE id % 5 <> 0
""")
def knowledge_records(spark, sf_dir):
    s, i = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    q = F.concat(F.lit("Q"), i.cast("string"))
    one = s.select(F.concat(F.lit("http://w/"), q).alias("co"), F.when(i % 5 == 0, q).otherwise(F.col("s_name")).alias("coLabel"), F.concat((1900 + i % 100).cast("string"), F.lit("-01-01")).alias("founded"), F.lit(None).cast("string").alias("closed"), F.lit("steel | iron").alias("industries"), F.lit("Ann").alias("founders"), F.lit(None).cast("string").alias("website"))
    more = one.where(i % 3 == 0).withColumns({"closed": F.lit("2005-02-02"), "founded": F.lit(None).cast("string")})
    rows = adapters.knowledge_graph_records(adapters.with_country(one.unionByName(more), "Atlantis"))
    return rows.select("name", "founded_year", "shutdown_year", "status", "country", F.array_join("categories", "|").alias("categories"), F.col("links")[0].alias("link"))


@query("""
SELECT n_name AS name, 'Rio' AS city, 'Fintech|Other' AS categories, 'Active' AS status FROM nation
""")
def ranking_records(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").select(F.concat(F.lit("var data = [{rank: 1, name: '"), F.col("n_name"), F.lit("', location: 'Rio/RJ', category: 'FinTechs', points: 10,}, {rank: 3, name: '"), F.col("n_name"), F.lit("', category: 'Other'},];")).alias("value"))
    return adapters.ranking_records(rows).select("name", "city", F.array_join("categories", "|").alias("categories"), "status")


@query("""
SELECT s_name AS name, n_name AS country, '1987' AS founded_year, CASE WHEN s_suppkey % 2 = 0 THEN 'Acquired' WHEN s_suppkey % 3 = 0 THEN 'Inactive' ELSE 'Active' END AS status, 'Steel' AS category FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def encyclopedia_records(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    i = F.col("s_suppkey")
    extract = F.when(i % 2 == 0, "It was acquired by Bar.").when(i % 3 == 0, "It ceased operations.").otherwise("A firm.")
    box = F.concat(F.lit("{{Infobox\n| founded = {{start}} 1987\n| industry = [[Steel]]\n| location = Lyon, "), F.col("n_name"), F.lit("\n}}"))
    out = adapters.encyclopedia(rows.select(F.concat("s_name", F.lit(" (company)")).alias("title"), extract.alias("extract"), box.alias("wikitext")))
    return out.select("name", "country", "founded_year", "status", F.col("categories")[0].alias("category"))


@query("""
WITH c AS (SELECT c_custkey AS id, lpad(c_custkey::VARCHAR, 14, '0') AS cnpj, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'Active' END AS status, CASE WHEN c_custkey % 6 = 0 THEN 'dead' ELSE 'unknown' END AS outcome FROM customer),
p AS (SELECT *, id % 3 <> 0 AS met, CASE id % 4 WHEN 0 THEN 'ATIVA' WHEN 1 THEN 'BAIXADA' WHEN 2 THEN 'INAPTA' ELSE 'x' END AS sit FROM c)
SELECT id, coalesce(status, CASE WHEN met THEN CASE sit WHEN 'ATIVA' THEN 'Active' WHEN 'x' THEN NULL ELSE 'Inactive' END END) AS status,
  CASE WHEN met AND outcome = 'unknown' THEN CASE sit WHEN 'ATIVA' THEN 'operating' WHEN 'BAIXADA' THEN 'dead' ELSE 'unknown' END ELSE outcome END AS outcome,
  CASE WHEN met AND sit = 'BAIXADA' THEN '2019' END AS shutdown_year, CASE WHEN met THEN '1995' END AS founded_year, CASE WHEN met THEN 'Ann|Bob' ELSE '' END AS founders,
  CASE WHEN met THEN 'own|Retail|Food' ELSE 'own' END AS categories, CASE WHEN met THEN 'Recife, PE' END AS location, CASE WHEN met THEN 'BRL 1.250.000' END AS total_funding, CASE WHEN met THEN 'cvm|tax_register' ELSE 'cvm' END AS sources FROM p
""")
def tax_register_fill(spark, sf_dir):
    i = F.col("c_custkey")
    none = F.lit(None).cast("string")
    c = load(spark, sf_dir, "customer").select(
        i.alias("id"), F.lpad(i.cast("string"), 14, "0").alias("cnpj"), F.when(i % 4 == 0, "Active").alias("status"), F.when(i % 6 == 0, "dead").otherwise("unknown").alias("outcome"), none.alias("shutdown_date"), none.alias("shutdown_year"), none.alias("founded_year"),
        F.array().cast("array<string>").alias("founders"), F.array(F.lit("own")).alias("categories"), none.alias("city"), none.alias("location"), none.alias("total_funding"), F.array(F.lit("cvm")).alias("sources"),
    )
    k = F.col("id")
    person = lambda x: F.struct(F.lit(x).alias("nome_socio"))
    p = c.where(k % 3 != 0).select(
        "cnpj", F.when(k % 4 == 0, "ATIVA").when(k % 4 == 1, "BAIXADA").when(k % 4 == 2, "INAPTA").otherwise("x").alias("descricao_situacao_cadastral"), F.lit("2019-03-04").alias("data_situacao_cadastral"), F.lit("1995-01-01").alias("data_inicio_atividade"),
        F.array(person("Ann"), person(""), person("Bob")).alias("qsa"), F.lit("Retail").alias("cnae_fiscal_descricao"), F.array(F.struct(F.lit("Food").alias("descricao")), F.struct(F.lit("").alias("descricao"))).alias("cnaes_secundarios"), F.lit("Recife").alias("municipio"), F.lit("PE").alias("uf"), F.lit(1250000.7).alias("capital_social"),
    )
    out = adapters.enriched(c, p.unionByName(p.withColumn("data_situacao_cadastral", F.lit("2001-01-01"))))
    return out.select("id", "status", "outcome", "shutdown_year", "founded_year", F.array_join("founders", "|").alias("founders"), F.array_join("categories", "|").alias("categories"), "location", "total_funding", F.array_join("sources", "|").alias("sources"))


def _page(spark, sf_dir, *parts):
    """Pages made of customers, which are few bytes and come as few partitions: they are dealt over tasks first, by their key, for the parsers to come."""
    rows = sinks.dealt(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name"), "c_custkey")
    return rows.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://h.io/company/c-"), F.col("c_custkey").cast("string")).alias("url"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("html"), "c_mktsegment", "c_name")


@query("""
SELECT c_custkey AS page_id, c_name AS name, 'A paragraph about ' || c_mktsegment || ' that is long enough to be a line.' AS one_liner,
  'Intro' || chr(10) || chr(10) || 'A paragraph about ' || c_mktsegment || ' that is long enough to be a line.' AS narrative, lower(c_mktsegment) AS industry, 'no cash & no market' AS reason, 2 AS fields FROM customer
""")
def interview_pages(spark, sf_dir):
    cell = lambda label, value: ['<div class="cemetery-page-data-category x">', label, '</div><div class="cemetery-page-data-information">', value, "</div>"]
    pages = _page(
        spark, sf_dir, "<html><body><h1>", F.col("c_name"), "</h1>", *cell("Category:", F.lower("c_mktsegment")), *cell("Cause of Failure", "no cash &amp; no market"), *cell("Reason", "second"), *cell("Odd", "x"),
        '<div class="content-black-rich-text"></div><div class="content-black-rich-text"><h2>Intro</h2><p>A paragraph about <b>', F.col("c_mktsegment"), "</b> that is long enough to be a line.</p><p>Subscribe to us</p><p>x</p></div><p>Outside of the body</p></body></html>",
    )
    return html.interviews(pages).select("page_id", "name", "one_liner", "narrative", F.element_at("meta", F.lit("industry")).alias("industry"), F.element_at("meta", F.lit("reason")).alias("reason"), F.size(F.map_keys("meta")).alias("fields"))


@query("""
WITH h(node, parent, level, heading, content, items) AS (VALUES (0, NULL, 2, 'seg', 'First.' || chr(10) || 'Second & more', 'a|b'), (1, 0, 3, 'Sub', '', ''), (2, 1, 4, 'Deep', 'name', ''), (3, 0, 3, 'Sub two', '', 'c'), (4, NULL, 2, 'Last', '', ''))
SELECT c_custkey AS page_id, node, parent, level, CASE heading WHEN 'seg' THEN c_mktsegment ELSE heading END AS heading, CASE content WHEN 'name' THEN c_name ELSE content END AS content, items FROM customer, h
""")
def section_trees(spark, sf_dir):
    pages = _page(spark, sf_dir, "<nav><h2>Menu</h2></nav><h2>", F.col("c_mktsegment"), "</h2><p>First.</p><p>Second &amp; more</p><ul><li>a</li><li>b</li></ul><h3>Sub</h3><h4>Deep</h4><p>", F.col("c_name"), "</p><h3>Sub two</h3><ol><li>c</li></ol><h2>Last</h2>")
    return html.section_tree(pages).withColumn("items", F.array_join("items", "|"))


@query("""
WITH h(node, parent) AS (VALUES (0, NULL), (1, 0), (2, 0))
SELECT CASE WHEN parent IS NULL THEN 'PAGE:' || c_custkey ELSE 'PAGE:' || c_custkey || '#' || parent END AS source, 'PAGE:' || c_custkey || '#' || node AS target, CASE WHEN parent IS NULL THEN 'HAS_SECTION' ELSE 'HAS_SUBSECTION' END AS relation FROM customer, h
""")
def section_graph(spark, sf_dir):
    pages = _page(spark, sf_dir, "<h2>", F.col("c_mktsegment"), "</h2><h3>a</h3><h3>b</h3>")
    return graph.section_tree_graph(html.section_tree(pages))[1]


@query("""
SELECT c_custkey AS page_id, 'c-' || c_custkey AS slug, c_name AS name, 'We do ' || c_mktsegment AS description, CASE WHEN c_custkey % 2 = 0 THEN 'Acquired' END AS status, 'Winter 2012' AS batch, '2011' AS founded_year,
  'https://site.io' AS website, 'c-x' AS related, 'Rival' AS competitors FROM customer
""")
def company_pages(spark, sf_dir):
    badge = F.when(F.col("c_custkey") % 2 == 0, '<span class="badge green"> acquired </span>').otherwise("")
    pages = _page(spark, sf_dir, '<meta property="og:title" content="', F.col("c_name"), '"><meta name="description" content="We do ', F.col("c_mktsegment"), '">', badge, "<b>Winter 2012</b><p>Founded in 2011, it competes with Rival</p>", '<a href="https://h.io/company/c-x/">x</a><a href="https://site.io">site</a><a href="/company/c-', F.col("c_custkey").cast("string"), '">me</a>')
    return html.company_pages(pages).select("page_id", "slug", "name", "description", "status", "batch", "founded_year", "website", F.array_join("related", "|").alias("related"), F.array_join("competitors", "|").alias("competitors"))


@query("""
SELECT c_custkey AS page_id, c_name AS name, (1990 + c_custkey % 30)::VARCHAR AS year, 'Berlin' AS location, 'Seed' AS stage, c_mktsegment AS listed, 'founded' AS field, '1999' AS value, 'p' AS slug FROM customer
""")
def listicle_cards(spark, sf_dir):
    pages = _page(
        spark, sf_dir, "<h2>", F.col("c_name"), "</h2><p>A card.</p><ul><li>Founded: 1999</li><li>plain</li></ul><table><tr><th>Company name</th><th>Segment</th></tr><tr><td>",
        F.concat("c_name", (1990 + F.col("c_custkey") % 30).cast("string"), F.lit(", Berlin, Seed")), "</td><td>", F.col("c_mktsegment"), '</td></tr></table><a href="/industry/p">P</a><a href="/about">no</a>',
    )
    rows = html.listicles(pages, {"packed": ["company", "name"], "listed": ["segment"]}, "/industry/").withColumn("cell", html.packed_cell(F.col("packed")))
    return rows.select("page_id", "cell.name", "cell.year", "cell.location", "cell.stage", "listed", "field", "value", "slug")


@query("""
SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'site' END AS name, 'https://www.site.io/' || c_custkey AS url FROM customer
""")
def portfolio_links(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ")
    pages = _page(spark, sf_dir, '<a class="x" href="https://www.site.io/', F.col("c_custkey").cast("string"), '">', text, '</a><a href="https://t.co/x">Twitter</a><a href="/own">Own</a>')
    return html.portfolio(pages, ["twitter"])


@query("""
SELECT s_name AS name, lower(s_name) AS kept, n_name AS country, 2 AS sources FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def corpus_files(spark, sf_dir):
    """Records written as JSON lines by the sink, read back by the corpus adapter, merged with another source."""
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    path = sinks.scratch(spark, "corpus")
    sinks.write_corpus(rows.select(F.col("s_name").alias("name"), F.lower("s_name").alias("norm"), F.lit(" ").alias("country")), path)
    a = adapters.ADAPTERS["corpus_lines"](spark, path).withColumn("source_ord", F.lit(0))
    b = adapters.canonical(rows.select(F.col("s_name").alias("name"), F.lower("s_name").alias("norm"), F.col("n_name").alias("country")), "other").withColumn("source_ord", F.lit(1))
    merged = linkage.merge_records(a.unionByName(b), ["name", "country"])
    return merged.select("name", F.col("norm").alias("kept"), "country", F.size("sources").alias("sources"))


def _graph(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    own, place = graph.node_id("company", F.col("s_name")), graph.node_id("country", F.col("n_name"))
    edges = graph.edges_of(rows, own, "BASED_IN", place)
    nodes = graph.nodes_of([rows.select(own.alias("id"), F.lit("company").alias("type"), F.concat("s_name", F.lit(" & <co>")).alias("name"))], edges)
    return nodes, edges


GRAPH = "e AS (SELECT 'COMPANY:' || s_name AS source, 'COUNTRY:' || n_name AS target, 'BASED_IN' AS relation, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


@query(f"""
WITH {GRAPH} SELECT 'node' AS kind, source AS id, 'company' AS type, s_name || ' & <co>' AS name FROM e UNION ALL SELECT DISTINCT 'node', target, 'unknown', target FROM e
UNION ALL SELECT 'edge', source, relation, target FROM e
""")
def node_link_files(spark, sf_dir):
    path = sinks.scratch(spark, "node-link")
    graph.write_node_link_document(*_graph(spark, sf_dir), path)
    nodes, edges = graph.read_node_link_lines(spark, path, "id string, type string, name string", "source string, target string, relation string")
    return nodes.select(F.lit("node").alias("kind"), "id", "type", "name").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), F.col("relation").alias("type"), F.col("target").alias("name")))


@query(f"""
WITH {GRAPH} SELECT 'node' AS kind, source AS id, 'company' AS type, s_name || ' & <co>' AS name FROM e UNION ALL SELECT DISTINCT 'node', target, 'unknown', target FROM e
UNION ALL SELECT 'edge', source, relation, target FROM e
""")
def gexf_files(spark, sf_dir):
    path = sinks.scratch(spark, "gexf")
    graph.write_gexf(*_graph(spark, sf_dir), path)
    nodes, edges = graph.read_gexf_lines(spark, path)
    return nodes.select(F.lit("node").alias("kind"), "id", "type", "name").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), F.col("relation").alias("type"), F.col("target").alias("name")))


_SHOP = "SELECT 'C' || o_custkey AS source, 'P' || l_partkey AS target, 'BOUGHT' AS relation FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"""
WITH e AS (SELECT DISTINCT * FROM ({_SHOP})) SELECT format, kind, id, name FROM (VALUES ('json'), ('gexf')) f(format),
  (SELECT 'node' AS kind, id, 'no. "' || id || '" <&>' AS name FROM (SELECT DISTINCT source AS id FROM e UNION SELECT DISTINCT target FROM e) UNION ALL SELECT 'edge', source, target FROM e)
""")
def graph_documents(spark, sf_dir):
    """The graph of who bought what as one JSON and one GEXF document, each written in parallel, and read back; one document is there at a time."""
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = sinks.stored(joined.select("o_custkey", "l_partkey").distinct().sortWithinPartitions("o_custkey", "l_partkey"), "bought")  # sorted, they pack
    edges = pairs.select(F.concat(F.lit("C"), "o_custkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target"), F.lit("BOUGHT").alias("relation"))
    ids = sinks.stored(edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct(), "bought-nodes")
    nodes = ids.select("id", F.lit("thing").alias("type"), F.concat(F.lit('no. "'), "id", F.lit('" <&>')).alias("name"))
    as_json = lambda path: graph.read_node_link_lines(spark, path, "id string, type string, name string", "source string, target string, relation string")
    out = None
    for form, write, read in (("json", graph.write_node_link_document, as_json), ("gexf", graph.write_gexf, lambda path: graph.read_gexf_lines(spark, path))):
        path = sinks.scratch(spark, f"graph-{form}")
        write(nodes, edges, path)
        n, e = read(path)
        both = n.select(F.lit("node").alias("kind"), "id", "name").unionByName(e.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), F.col("target").alias("name")))
        found = sinks.stored(both, f"read-{form}").select(F.lit(form).alias("format"), "*")
        sinks.remove(spark, path)  # its rows are stored, packed
        out = found if out is None else out.unionByName(found)
    return out


@query("""
WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS name, c_mktsegment AS segment FROM customer), b AS (SELECT s_suppkey * 2 AS k, s_name AS name, 'SUPPLY' AS segment FROM supplier)
SELECT 1 AS version, * FROM a UNION ALL SELECT 2, coalesce(a.k, b.k), coalesce(nullif(trim(a.name), ''), nullif(trim(b.name), '')), coalesce(b.segment, a.segment) FROM a FULL JOIN b ON a.k = b.k
""")
def versioned_upsert(spark, sf_dir):
    """Customers as the first version of a table, suppliers upserted as the second; a write that fails in between leaves the first as it is."""
    table = versions.VersionedTable(spark, sinks.scratch(spark, "versioned"))
    old = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))
    new = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_name").alias("name"), F.lit("SUPPLY").alias("segment"))
    table.commit(old)
    try:
        table.upsert(new.withColumn("name", F.when(F.col("k") >= 0, F.raise_error(F.lit("planted"))).otherwise(F.col("name"))), "k", {"segment": "overwrite"})
        raise AssertionError("the planted failure was committed")
    except PySparkException:
        pass  # the version before stays the last
    table.upsert(new, "k", {"segment": "overwrite"})
    return table.read(1).select(F.lit(1).alias("version"), "*").unionByName(table.read().select(F.lit(2).alias("version"), "*"))


PRO = ", ".join(f"'{m}'" for m in lx.PAYWALL_MARKERS)


@query(f"""
WITH r AS (SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (Winter 2012)' ELSE '' END AS name, 'Overview of ' || c_mktsegment AS overview, CASE WHEN c_custkey % 3 = 0 THEN 'Use one of your 5 monthly Pro research runs' ELSE repeat('raw text ', 10) || c_custkey END AS raw FROM customer),
n AS (SELECT *, trim(overview || CASE WHEN id % 3 = 0 THEN '' ELSE ' ' || trim(raw) END) AS narrative FROM r)
SELECT id, narrative FROM n WHERE length(narrative) > 80
""")
def narrative_lookup(spark, sf_dir):
    i = F.col("c_custkey")
    c = load(spark, sf_dir, "customer").select(i.alias("id"), F.concat("c_name", F.when(i % 2 == 0, " (Winter 2012)").otherwise("")).alias("name"), F.concat(F.lit("Overview of "), F.col("c_mktsegment")).alias("overview"), F.when(i % 3 == 0, "Use one of your 5 monthly Pro research runs").otherwise(F.concat(F.repeat(F.lit("raw text "), 10), i.cast("string"))).alias("raw"))
    from peerlens.functions import text as tx

    lookup = linkage.narratives(c.select("name", "overview", "raw"), ["overview"], "raw", lx.PAYWALL_MARKERS)
    asked = c.select("id", tx.entity_key_without_parenthesis(F.col("name")).alias("clean"), tx.entity_key(F.col("name")).alias("full"))
    return linkage.looked_up_by_keys(asked, lookup, ["clean", "full"], "key", "narrative").where("narrative is not null").select("id", "narrative")
