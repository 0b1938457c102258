"""Queries that apply the scalar functions to whole tables, each with the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.functions import text as tx
from peerlens.operators import scoring

from .registry import load, query, values

_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\b(limited|gmbh|corp|s\.a\.|srl|llc|ltd|plc|inc|s\.a|co|sa|bv|ag|oy|ab)\b\.?', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"

PEOPLE = """p AS (
  SELECT c_custkey AS id, c_mktsegment AS seg, n_name AS nation,
    c_name || CASE c_custkey % 3 WHEN 0 THEN ' (' || c_mktsegment || ')' WHEN 1 THEN ' Ltd' ELSE '' END AS name,
    CASE c_custkey % 3 WHEN 0 THEN 'Città ' || c_custkey || ', ' || n_name || '; Remote' WHEN 1 THEN n_name ELSE c_mktsegment || ', Old Town, ' || n_name END AS place,
    CASE WHEN c_custkey % 2 = 0 THEN '12.345.678/' || lpad(c_custkey::VARCHAR, 6, '0') ELSE lpad(c_custkey::VARCHAR, 5, '0') END AS reg,
    CASE c_custkey % 4 WHEN 0 THEN 'http://example.org/' || c_name WHEN 1 THEN 'example.org/x/' || c_custkey WHEN 2 THEN '  ' ELSE 'https://a.b/c' END AS url,
    CASE WHEN c_custkey % 5 = 0 THEN '!!' WHEN c_custkey % 7 = 0 THEN 'ab' ELSE n_name || ' & Co' END AS raw,
    ['Retail', lower(c_mktsegment), c_mktsegment, 'retail', 'X' || (c_custkey % 3)] AS words
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _people(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k, seg, nation = F.col("c_custkey"), F.col("c_mktsegment"), F.col("n_name")
    text, at = k.cast("string"), lambda n: k % n
    return rows.select(
        k.alias("id"), seg.alias("seg"), nation.alias("nation"),
        F.concat("c_name", F.when(at(3) == 0, F.concat(F.lit(" ("), seg, F.lit(")"))).when(at(3) == 1, " Ltd").otherwise("")).alias("name"),
        F.when(at(3) == 0, F.concat(F.lit("Città "), text, F.lit(", "), nation, F.lit("; Remote"))).when(at(3) == 1, nation).otherwise(F.concat(seg, F.lit(", Old Town, "), nation)).alias("place"),
        F.when(at(2) == 0, F.concat(F.lit("12.345.678/"), F.lpad(text, 6, "0"))).otherwise(F.lpad(text, 5, "0")).alias("reg"),
        F.when(at(4) == 0, F.concat(F.lit("http://example.org/"), F.col("c_name"))).when(at(4) == 1, F.concat(F.lit("example.org/x/"), text)).when(at(4) == 2, "  ").otherwise("https://a.b/c").alias("url"),
        F.when(at(5) == 0, "!!").when(at(7) == 0, "ab").otherwise(F.concat(nation, F.lit(" & Co"))).alias("raw"),
        F.array(F.lit("Retail"), F.lower(seg), seg, F.lit("retail"), F.concat(F.lit("X"), at(3).cast("string"))).alias("words"),
    )


@query(f"""
WITH {PEOPLE}
SELECT id, {_KEY.format("regexp_replace(name, '\\s*\\([^)]*\\)\\s*$', '')")} AS clean_key,
  translate(lower(place), '{lx.ACCENTED}', '{lx.FOLDED}') AS folded,
  trim(list_last(string_split(string_split(place, ';')[1], ','))) AS country,
  CASE WHEN len(string_split(string_split(place, ';')[1], ',')) > 1 THEN trim(string_split(string_split(place, ';')[1], ',')[1]) END AS city,
  CASE WHEN length(regexp_replace(reg, '[^0-9]', '', 'g')) = 14 THEN regexp_replace(reg, '[^0-9]', '', 'g') END AS registry,
  CASE WHEN nullif(trim(url), '') IS NULL THEN NULL WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS site,
  list_last(string_split(url, '/')) AS tail,
  coalesce(nullif(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug,
  array_to_string(list_filter(words, lambda x, i: list_position(list_transform(words, lambda y: lower(y)), lower(x)) = i), '|') AS spellings,
  CASE WHEN length(name) > 12 THEN left(name, 11) || '…' ELSE name END AS short,
  concat_ws(' ', seg, array_to_string(words, ' '), nullif(raw, '!!')) AS flat
FROM p
""")
def string_functions(spark, sf_dir):
    c = F.col
    return _people(spark, sf_dir).select(
        "id",
        tx.entity_key_without_parenthesis(c("name")).alias("clean_key"),
        tx.fold_accents(c("place")).alias("folded"),
        tx.country_of_location(c("place")).alias("country"),
        tx.city_of_location(c("place")).alias("city"),
        tx.registry_id(c("reg")).alias("registry"),
        tx.with_scheme(c("url")).alias("site"),
        tx.uri_tail(c("url")).alias("tail"),
        tx.slug(c("raw"), "unknown").alias("slug"),
        F.array_join(tx.distinct_ignoring_case(c("words")), "|").alias("spellings"),
        tx.short(c("name"), 12).alias("short"),
        tx.flattened(c("seg"), c("words"), F.nullif(c("raw"), F.lit("!!"))).alias("flat"),
    )


_CUT = "market"
for _phrase, _behind in [*[(p, r"[:\s]+") for p in sorted(lx.RIVAL_TITLES, key=len, reverse=True)], *[(p, r"\s*") for p in sorted(lx.RIVAL_CUES, key=len, reverse=True)]]:
    _CUT = f"regexp_replace({_CUT}, '{_phrase.replace('.', '[.]').replace(' ', '[ ]+')}{_behind}', chr(31), 'g')"


@query(f"""
WITH {PEOPLE}, s AS (SELECT id, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, url,
  '<a href="/company/self">x</a><a href="https://h.io/company/' || lower(seg) || '/">y</a><a href="/company/' || id || '">z</a><a href="/company/' || lower(seg) || '">w</a>' AS html,
  CASE id % 3 WHEN 0 THEN 'Acme vs. ' || seg || 'Corp wins' WHEN 1 THEN 'It competes with Nation' || id || ' and versus Other' ELSE 'competitors: Foo Bar vs foo' END AS market FROM p)
SELECT id, length(slug) BETWEEN 3 AND 80 AND regexp_matches(slug, '^[a-z0-9][a-z0-9-]*$') AND slug NOT IN ('about-co', 'china-co') AS valid,
  array_to_string(list_distinct_in_order, '|') AS related, array_to_string(names, '|') AS competitors
FROM (SELECT *, list_filter(r, lambda x, i: list_position(r, x) = i) AS list_distinct_in_order, list_filter(m, lambda x, i: list_position(m, x) = i) AS names
  FROM (SELECT *, list_filter(list_transform(regexp_extract_all(html, 'href="[^"]*/company/([^"]*)"', 1), lambda x: trim(x, '/')), lambda x: x <> '' AND NOT contains(x, 'self')) AS r,
    list_filter(list_transform(string_split({_CUT}, chr(31))[2:], lambda x: regexp_extract(x, '{tx.RIVAL_NAME}')), lambda x: x <> '') AS m FROM s))
""")
def relation_extract(spark, sf_dir):
    p, i = _people(spark, sf_dir), F.col("id").cast("string")
    seg, slug = F.lower("seg"), tx.slug(F.col("raw"), "")
    html = F.concat(F.lit('<a href="/company/self">x</a><a href="https://h.io/company/'), seg, F.lit('/">y</a><a href="/company/'), i, F.lit('">z</a><a href="/company/'), seg, F.lit('">w</a>'))
    market = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Acme vs. "), F.col("seg"), F.lit("Corp wins"))).when(F.col("id") % 3 == 1, F.concat(F.lit("It competes with Nation"), i, F.lit(" and versus Other"))).otherwise("competitors: Foo Bar vs foo")
    return p.select("id", tx.valid_slug(slug, ["about-co", "china-co"]).alias("valid"), F.array_join(tx.related_slugs(html, F.lit("self")), "|").alias("related"), F.array_join(tx.competitor_names(market), "|").alias("competitors"))


_FIRST = r"(CASE WHEN regexp_extract(left(trim(coalesce({0}, '')), 200), '(?s)^(.*?\.)(?:\s|$)', 1) <> '' THEN regexp_extract(left(trim(coalesce({0}, '')), 200), '(?s)^(.*?\.)(?:\s|$)', 1) ELSE left(trim(coalesce({0}, '')), 180) END)"


@query(f"""
WITH d AS (SELECT doc_id, source, text, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN ' ' END AS liner, CASE WHEN doc_id % 2 = 0 THEN text END AS description FROM documents),
s AS (SELECT *, {_FIRST.format('text')} AS sentence, nullif(trim({_FIRST.format('description')}), '') AS said FROM d)
SELECT doc_id, sentence,
  left(concat_ws(' ', nullif(trim(source), ''), nullif(trim(liner), ''), said, CASE WHEN nullif(trim(liner), '') IS NULL AND said IS NULL THEN nullif(trim(sentence), '') END), 400) AS semantic
FROM s
""")
def semantic_texts(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").withColumns({"liner": F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, " "), "description": F.when(F.col("doc_id") % 2 == 0, F.col("text"))})
    return rows.select("doc_id", tx.first_sentence(F.col("text")).alias("sentence"), tx.semantic_text(F.col("source"), F.col("liner"), F.col("description"), F.col("text")).alias("semantic"))


@query(r"""
WITH w AS (SELECT s_suppkey AS id, '<!-- c' || s_suppkey || ' -->''''''' || s_name || ''''''' is a [[firm|company]] of [[' || n_name || ']]<ref name="x">cite</ref>, {{cn|a}} see [http://e.org the  site]<br/> end' AS body,
  '{{Infobox' || chr(10) || '| name = ' || s_name || chr(10) || '| location = [[' || n_name || ']]' || chr(10) || ' | founded = {{start}} ' || (1900 + s_suppkey % 120) || chr(10) || '|name = again' || chr(10) || '}}' AS box, s_name, n_name
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT id, s_name || ' is a company of ' || n_name || ', see the site end' AS plain, 'again' AS box_name, n_name AS box_place, (1900 + id % 120)::VARCHAR AS box_year, 3 AS box_fields FROM w
""")
def wiki_texts(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    i, name, nation = F.col("s_suppkey"), F.col("s_name"), F.col("n_name")
    body = F.concat(F.lit("<!-- c"), i.cast("string"), F.lit(" -->'''"), name, F.lit("''' is a [[firm|company]] of [["), nation, F.lit(']]<ref name="x">cite</ref>, {{cn|a}} see [http://e.org the  site]<br/> end'))
    box = tx.infobox(F.concat(F.lit("{{Infobox\n| name = "), name, F.lit("\n| location = [["), nation, F.lit("]]\n | founded = {{start}} "), (1900 + i % 120).cast("string"), F.lit("\n|name = again\n}}")))
    rows = rows.select(i.alias("id"), tx.plain_wiki(body).alias("plain"), box.alias("box"))
    return rows.select("id", "plain", F.element_at("box", F.lit("name")).alias("box_name"), F.element_at("box", F.lit("location")).alias("box_place"), F.element_at("box", F.lit("founded")).alias("box_year"), F.size(F.map_keys("box")).alias("box_fields"))


SECTORS = ["ENERGIA ELETRICA E GAS", "Banco do Sul", "COMERCIO VAREJISTA", "petroleo, combustiveis", "outros setores x", "Unknown Thing", "", "FinTechs", "SERVICOS MEDICOS", "AGROPECUARIA"]


def _sector_sql(table: list[tuple[str, str]], test: str) -> str:
    cases = " ".join(f"WHEN {test.format(part)} THEN '{name}'" for part, name in table)
    return f"CASE WHEN coalesce(s, '') = '' THEN '' {cases} ELSE array_to_string(list_transform(string_split(lower(s), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END"


@query(f"""
WITH t(k, s) AS (VALUES {values(list(enumerate(SECTORS)))}), o AS (SELECT o_orderkey, s FROM orders JOIN t ON k = o_orderkey % {len(SECTORS)})
SELECT o_orderkey, {_sector_sql(lx.REGISTER_SECTORS, "contains(upper(s), '{0}')")} AS register,
  {_sector_sql([(p[:10], n) for p, n in lx.HOLDING_SECTORS], "starts_with(upper(s), '{0}')")} AS holding,
  CASE s {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.RANKING_CATEGORIES.items())} ELSE s END AS ranking FROM o
""")
def sector_maps(spark, sf_dir):
    s = F.get(F.array(*[F.lit(x) for x in SECTORS]), (F.col("o_orderkey") % len(SECTORS)).cast("int"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))
    return rows.select("o_orderkey", cl.sector_by_part(F.col("s")).alias("register"), cl.sector_by_start(F.col("s")).alias("holding"), cl.sector_by_name(F.col("s")).alias("ranking"))


SITUATIONS = ["ATIVA", " baixada ", "Suspensa", "INAPTA", "nula", "other", ""]
CATEGORIES = ["SaaS", "Fintech", "Machine Learning", "food", "People", "Nothing", "API", "Climate"]


@query(f"""
WITH t(k, s) AS (VALUES {values(list(enumerate(SITUATIONS)))}), c(k, cat) AS (VALUES {values(list(enumerate(CATEGORIES)))}),
m(ord, macro, word) AS (VALUES {values([(i, m, w) for i, (m, ws) in enumerate(lx.LITE_MACROS.items()) for w in ws])}),
e AS (SELECT event_id, upper(trim(s)) AS s, event_id % 8 AS a, (event_id // 8) % 8 AS b, event_id % 11 = 0 AS given FROM events JOIN t ON t.k = event_id % {len(SITUATIONS)}),
g AS (SELECT event_id, list(DISTINCT (ord, macro)) AS ms FROM e JOIN c ON c.k = e.a OR c.k = e.b JOIN m ON word = lower(cat) GROUP BY event_id)
SELECT e.event_id, CASE s WHEN 'ATIVA' THEN 'Active' WHEN 'BAIXADA' THEN 'Inactive' WHEN 'SUSPENSA' THEN 'Inactive' WHEN 'INAPTA' THEN 'Inactive' WHEN 'NULA' THEN 'Inactive' ELSE '' END AS status,
  CASE s WHEN 'ATIVA' THEN 'operating' WHEN 'BAIXADA' THEN 'dead' ELSE 'unknown' END AS outcome,
  CASE WHEN given THEN 'given' ELSE coalesce(array_to_string(list_transform(list_sort(ms), lambda x: x[2]), '|'), '') END AS macros,
  coalesce(CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE e.event_id % 600 END BETWEEN 200 AND 399, false) AS alive
FROM e LEFT JOIN g USING (event_id)
""")
def classify_lite(spark, sf_dir):
    at = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    i = F.col("event_id")
    cats = F.array(at(CATEGORIES, i % 8), at(CATEGORIES, F.floor(i / 8) % 8))
    given = F.when(i % 11 == 0, F.array(F.lit("given"))).otherwise(F.array().cast("array<string>"))
    s = cl.registry_situation(at(SITUATIONS, i % len(SITUATIONS)))
    return load(spark, sf_dir, "events").select("event_id", s["status"].alias("status"), s["outcome"].alias("outcome"), F.array_join(cl.lite_macros(cats, given), "|").alias("macros"), cl.probe_alive(F.when(i % 5 != 0, i % 600)).alias("alive"))


BATCHES = ["Winter 2021", "W09", "s98", "Summer 12", "x", "IK12"]
HEADS = ["1", "2-5", "51-100 employees", "1,200", "12000", "none", "300 to 400"]


@query(f"""
WITH b(k, s) AS (VALUES {values(list(enumerate(BATCHES)))}), h(k, n) AS (VALUES {values(list(enumerate(HEADS)))}),
x AS (SELECT p_partkey, s, list_transform(regexp_extract_all(replace(lower(n), ' ', ''), '[0-9]+'), lambda v: v::BIGINT) AS nums FROM part JOIN b ON b.k = p_partkey % {len(BATCHES)} JOIN h ON h.k = p_partkey % {len(HEADS)}),
m AS (SELECT *, CASE WHEN len(nums) = 1 THEN nums[1] WHEN len(nums) > 1 THEN floor((nums[1] + nums[-1]) / 2)::BIGINT END AS mid, try_cast(nullif(regexp_extract(s, '(?i)^[a-z]+\\s*([0-9]{{2}})$', 1), '') AS INT) AS two FROM x),
o AS (SELECT *, CASE {" ".join(f"WHEN mid BETWEEN {a} AND {b} THEN {n}" for a, b, n in lx.HEADCOUNT_BANDS)} WHEN mid > {lx.HEADCOUNT_BANDS[-1][1]} THEN {lx.HEADCOUNT_BANDS[-1][2]} END AS band FROM m)
SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(s, '([0-9]{{4}})', 1), '') AS INT), CASE WHEN two < 50 THEN 2000 + two ELSE 1900 + two END)::INT AS year, CASE WHEN band IS NOT NULL THEN least(8, greatest(0, band - 1)) END::INT AS stage FROM o
""")
def batch_and_stage(spark, sf_dir):
    at = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % len(names)).cast("int"))
    stage = F.when(cl.headcount_band(at(HEADS)).isNotNull(), cl.implicit_stage(at(HEADS)))
    return load(spark, sf_dir, "part").select("p_partkey", cl.batch_year(at(BATCHES)).alias("year"), stage.alias("stage"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS lex, l_discount * 10 AS sec, CASE WHEN l_partkey % 3 = 0 THEN 'funds' WHEN l_partkey % 3 = 1 THEN 'timing' ELSE '' END AS has,
  CASE WHEN l_suppkey % 2 = 0 THEN 'funds' ELSE 'timing' END AS asked, l_linenumber % 2 = 0 AS inferred, l_linestatus = 'O' AS told, l_returnflag <> 'N' AS dead FROM lineitem),
d AS (SELECT *, CASE WHEN lex >= 0.08 THEN least(lex, 1.0) END AS lexical, CASE WHEN asked = has THEN 1.0 END AS cause, CASE WHEN has <> '' AND has IN ('timing', 'none') THEN 1.0 END AS secondary,
  CASE WHEN sec >= 0.22 THEN greatest(0.0, least(1.0, (sec - 0.22) / 0.48)) END AS semantic FROM x),
p AS (SELECT *, coalesce(lexical * 15, 0) AS p_lex, coalesce(cause * CASE WHEN inferred THEN 16 ELSE 28 END * CASE WHEN told THEN 1.0 ELSE 0.6 END, 0) AS p_cause, coalesce(secondary * 8, 0) AS p_sec, coalesce(semantic * 24 * 0.7, 0) AS p_sem,
  (coalesce(lexical, 0) >= 0.3)::INT + (coalesce(cause, 0) >= 0.3)::INT + (coalesce(secondary, 0) >= 0.3)::INT + (coalesce(semantic, 0) >= 0.3)::INT AS strong FROM d)
SELECT l_orderkey, l_linenumber, count(*) AS rows, sum(strong)::BIGINT AS strong, sum(CASE WHEN dead AND strong >= 4 THEN 1 ELSE 0 END)::BIGINT AS clones,
  round(sum(p_lex + p_cause + p_sec + p_sem + CASE WHEN dead AND strong >= 4 THEN 20 ELSE 0 END), 4) AS score FROM p GROUP BY ALL
""")
def score_texts_and_causes(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("lex"), (F.col("l_discount") * 10).alias("sem"), (F.col("l_linenumber") % 2 == 0).alias("inferred"), (F.col("l_linestatus") == "O").alias("told"),
        (F.col("l_returnflag") != "N").alias("dead"), F.when(F.col("l_partkey") % 3 == 0, "funds").when(F.col("l_partkey") % 3 == 1, "timing").otherwise("").alias("has"), F.when(F.col("l_suppkey") % 2 == 0, "funds").otherwise("timing").alias("asked"),
    )
    dims = [scoring.lexical(F.col("lex")), scoring.cause(F.col("asked"), F.col("has"), F.col("inferred"), F.col("told")), scoring.secondary(F.array(F.lit("timing"), F.lit("none")), F.col("has")), scoring.semantic(F.col("sem"), 0.7)]
    scored = scoring.with_score(rows, dims, F.col("dead")).withColumn("strong", scoring.strong(F.col("dims")))
    return scored.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("rows"), F.sum("strong").alias("strong"), F.count_if("convergence").alias("clones"), F.round(F.sum("score"), 4).alias("score"))
