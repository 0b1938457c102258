"""Queries that match a stated set of companies (ids divisible by 100) against all: scores, ranks, segments, signals.

Best matches come from bounds of blocks (operators.retrieval); distributions over all companies come from cells of equal companies or from
signatures of segments, so no query emits or compares all pairs of companies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.functions import text as tx
from peerlens.operators import cohorts, containment, scoring, segments, vectors
from peerlens.sources.sinks import dealt, stored

from . import consult
from .analogs import ASKED, COMPANIES, companies, round4, sql_tokens
from .registry import load, query, values

SCORED = f"""{COMPANIES},
q AS (SELECT company_id AS query_id, category AS q_category, country AS q_country, founded_year AS q_year, outcome AS q_outcome, n_orders AS q_orders, balance AS q_balance FROM company WHERE {ASKED}),
p AS (SELECT q.*, c.*, CASE WHEN q_category = category THEN 16.0 ELSE 0 END AS d_macro, CASE WHEN q_category = category THEN 10.0 ELSE 0 END AS d_category,
  CASE WHEN contains(q_country, country) OR contains(country, q_country) THEN 7.0 ELSE 0 END AS d_country,
  CASE WHEN abs(q_year - founded_year) <= 3 THEN 5.0 * (1 - pow(abs(q_year - founded_year) / 4.0, 1.5)) ELSE 0 END AS d_era,
  CASE WHEN abs(q_year - founded_year) <= 3 AND (1 - pow(abs(q_year - founded_year) / 4.0, 1.5)) >= 0.3 THEN 1 ELSE 0 END
   + CASE WHEN q_category = category THEN 2 ELSE 0 END + CASE WHEN contains(q_country, country) OR contains(country, q_country) THEN 1 ELSE 0 END AS strong
  FROM q JOIN company c ON c.company_id <> query_id),
s AS (SELECT *, outcome = 'dead' AND strong >= 4 AS convergence, d_macro + d_category + d_country + d_era + CASE WHEN outcome = 'dead' AND strong >= 4 THEN 20.0 ELSE 0 END AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, company_id) AS rank FROM s WHERE score >= 18.0),
sim AS (SELECT *, (0.35 * (q_country = country)::INT + 0.20 * greatest(0.0, 1 - abs(q_year - founded_year) / 20.0) + 0.20 * greatest(0.0, 1 - abs(q_orders - n_orders) / 5.0)) / 0.75 AS similarity FROM r),
f AS (SELECT *, CASE WHEN rank <= 50 THEN score * (0.6 + 0.4 * similarity) ELSE score END AS final_score FROM sim),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 50 THEN 0 ELSE 1 END, CASE WHEN rank <= 50 THEN -round(final_score, 9) END, rank) AS final_rank FROM f)"""


def _as_companies(rows: DataFrame) -> DataFrame:
    """The columns of a consultation for companies that have a category, a country, a year and a status only."""
    none = F.lit(None).cast("string")
    return rows.withColumns({"macros": F.array("category"), "categories": F.array("category"), "description": none, "cause": none, "cause_inferred": F.lit(False)})


def _as_queries(rows: DataFrame) -> DataFrame:
    """The columns of analyzed queries for companies that ask."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    q = rows.select(F.col("company_id").alias("query_id"), "macros", F.transform("categories", tx.compact_key).alias("category_keys"), F.col("country").alias("country_key"), F.col("founded_year").alias("year"), "cause", "description", "n_orders")
    words = tx.tokens(F.col("description"))
    return q.withColumns({"model": none, "secondary": empty, "stage": none, "team_size": F.col("n_orders"), "words": words, "quality": scoring.input_quality(words, F.col("description"))})


def _best(spark, sf_dir: str, k: int) -> DataFrame:
    """The k best of each company that asks; companies are of few kinds, so kinds are searched."""
    rows = stored(_as_companies(companies(spark, sf_dir)), "companies")
    return consult.best_by_kinds(_as_queries(rows.where(ASKED)), rows, k, others=True)


def _outcomes(spark, sf_dir: str, k: int) -> DataFrame:
    """query_id, rank, score, outcome of the k best."""
    return _best(spark, sf_dir, k).select("query_id", "rank", "score", "outcome")


_CELL = ["category", "country", "founded_year", "outcome"]


def _scored_cells(rows: DataFrame) -> DataFrame:
    """The distinct cells (q_...) of companies that ask against the cells of all companies, equal ones for a score in each, with dims, score and `n` companies other than the one that asks.

    As many pairs as there are kinds of companies, squared, whatever the number of queries and companies.
    """
    cells = stored(rows.groupBy(*_CELL).agg(F.count("*").alias("n")), "cells")
    q = rows.where(ASKED).select(*[F.col(c).alias(f"q_{c}") for c in _CELL]).distinct()
    # dealt over tasks: cells are few rows, which would come as one partition
    dealt = cells.repartition(max(8, rows.sparkSession.sparkContext.defaultParallelism))
    pairs = vectors.against_all(dealt, stored(q, "asked-cells"), "q_category", F.lit(True))
    own = F.lit(True)
    for c in _CELL:
        own = own & F.col(c).eqNullSafe(F.col(f"q_{c}"))
    dims = [
        scoring.overlap("macro", F.array("q_category"), F.array("category"), lx.WEIGHTS["macro"]),
        scoring.overlap("category", F.array(tx.compact_key(F.col("q_category"))), F.array(tx.compact_key(F.col("category"))), lx.WEIGHTS["category"]),
        scoring.country(F.col("q_country"), F.col("country")),
        scoring.era(F.col("q_founded_year"), F.col("founded_year")),
    ]
    return scoring.with_score(pairs.withColumn("n", F.col("n") - own.cast("int")).where("n > 0"), dims, F.col("outcome") == "dead")


def _asking(rows: DataFrame) -> DataFrame:
    """query_id and the cell (q_...) of each company that asks."""
    return rows.where(ASKED).select(F.col("company_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in _CELL])


#: A list of companies that ask spans 2^20 keys, of which one in a hundred asks.
LISTED = 20


@query(f"WITH {SCORED} SELECT query_id, company_id, {round4('d_macro + d_category')} AS segment_points, {round4('d_country')} AS country_points, {round4('d_era')} AS era_points, strong::INT AS strong FROM p")
def score_dimensions(spark, sf_dir):
    """Points of each dimension for every query and every other company; those of equal companies are computed once."""
    def points(*names: str):
        return cl.round4(scoring.total(F.filter("dims", lambda d: d["name"].isin(*names))))

    rows = stored(companies(spark, sf_dir).select("company_id", *_CELL), "companies")
    asked = F.struct(*[f"q_{c}" for c in _CELL]).alias("asked")
    cell = F.struct(*_CELL).alias("cell")
    told = [points("macro", "category").alias("segment_points"), points("country").alias("country_points"), points("era").alias("era_points"), scoring.strong(F.col("dims")).alias("strong")]
    scored = _scored_cells(rows).select(asked, cell, *told)
    # those that ask come as lists, of a cell and a range of keys, so that pairs arise behind the last shuffle only
    lists = _asking(rows).groupBy(asked, F.shiftright("query_id", LISTED).alias("keys")).agg(F.collect_list("query_id").alias("ids"))
    equal = ["cell", "keys", "segment_points", "country_points", "era_points", "strong"]
    listed = stored(scored.join(lists, "asked").groupBy(*equal).agg(F.flatten(F.collect_list("ids")).alias("ids")), "scored-cells")
    # merged: lists are a small file that may be large in memory, so neither side is broadcast
    met = dealt(listed, "cell").join(dealt(rows.select("company_id", cell), "cell").hint("merge"), "cell")
    return met.select(F.explode("ids").alias("query_id"), "company_id", *equal[2:]).where("company_id <> query_id")


@query(f"WITH {SCORED} SELECT query_id, company_id, rank, {round4('score')} AS score, convergence FROM r WHERE rank <= 25")
def score_converged_topk(spark, sf_dir):
    return _best(spark, sf_dir, 25).select("query_id", "company_id", "rank", cl.round4(F.col("score")).alias("score"), "convergence")


@query(f"WITH {SCORED} SELECT query_id, company_id, rank, final_rank, {round4('final_score')} AS final_score FROM fr WHERE final_rank <= 60")
def profile_rerank(spark, sf_dir):
    parts = {
        "country": F.when(F.col("q_country_key") == F.col("c_country"), 1.0).otherwise(0.0),
        "decade": scoring.nearness(F.col("q_year"), F.col("c_year"), 20.0),
        "headcount": scoring.nearness(F.col("q_team_size"), F.col("n_orders"), 5.0),
        "stage": F.lit(None).cast("double"),
        "model": F.lit(None).cast("double"),
    }
    rows = scoring.rerank(_best(spark, sf_dir, 60).withColumn("similarity", scoring.profile_similarity(parts)), "similarity")
    return rows.where("final_rank <= 60").select("query_id", "company_id", "rank", "final_rank", cl.round4(F.col("final_score")).alias("final_score"))


@query(f"""WITH {SCORED} SELECT query_id, CASE WHEN convergence THEN 'high' WHEN score >= 55 AND strong >= 3 THEN 'high' WHEN score >= 35 AND strong >= 2 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM r GROUP BY ALL""")
def match_confidence(spark, sf_dir):
    rows = stored(companies(spark, sf_dir).select("company_id", *_CELL), "companies")
    scored = _scored_cells(rows).where(F.col("score") >= lx.MIN_SCORE)
    level = scoring.confidence(F.col("score"), F.col("dims"), F.col("convergence"), F.lit(False))
    asked = [f"q_{c}" for c in _CELL]
    counts = stored(scored.groupBy(*asked, level.alias("confidence")).agg(F.sum("n").alias("n")), "confidences")
    return _asking(rows).join(counts, asked).select("query_id", "confidence", "n")


SEGMENT = """seg AS (SELECT query_id, count(*) FILTER (outcome = 'operating') AS operating, count(*) FILTER (outcome = 'acquired') AS acquired, count(*) FILTER (outcome = 'dead') AS dead, count(*) FILTER (outcome = 'unknown') AS unknown, count(*) AS total FROM p WHERE q_category = category GROUP BY query_id)"""


def _segments(spark, sf_dir) -> DataFrame:
    """query_id and outcomes of its segment, without the company that asks."""
    rows = _as_companies(companies(spark, sf_dir))
    asked = rows.where(ASKED).select(F.col("company_id").alias("query_id"), "macros", F.col("outcome").alias("_own"))
    found = segments.outcomes(segments.of_queries(asked, segments.cells(rows)))
    rest = asked.withColumn("asked", segments.signature(F.col("macros"))).join(found, "asked")
    own = {o: F.col(o) - (F.col("_own") == o).cast("int") for o in cohorts.OUTCOMES} | {"total": F.col("total") - 1}
    return rest.withColumns(own).where("total > 0").select("query_id", *own)


@query(f"WITH {SCORED}, {SEGMENT} SELECT query_id, operating, acquired, dead, unknown, total, {round4('dead / total')} AS dead_share, CASE WHEN total < 10 THEN 0.5 WHEN total < 20 THEN 0.75 ELSE 1.0 END::DOUBLE AS trust FROM seg")
def segment_stats(spark, sf_dir):
    return _segments(spark, sf_dir).select("*", cl.share(F.col("dead"), F.col("total")).alias("dead_share"), cohorts.segment_trust(F.col("total")).alias("trust"))


PATH = f"""{SCORED}, {SEGMENT}, top AS (SELECT query_id, count(*) FILTER (outcome = 'dead') AS dead, count(*) AS total FROM r WHERE rank <= 15 GROUP BY query_id),
sig AS (SELECT query_id, CASE WHEN coalesce(t.total, 0) = 0 THEN 'SEM_MATCHES' WHEN coalesce(s.total, 0) = 0 THEN 'SEM_SEGMENTO' WHEN s.total < 20 THEN 'INCERTO' WHEN t.dead / t.total - s.dead / s.total >= 0.20 THEN 'NEGATIVO' WHEN t.dead / t.total - s.dead / s.total <= -0.15 THEN 'POSITIVO' ELSE 'NEUTRO' END AS direction,
  floor((t.dead / t.total - s.dead / s.total) * 10000 + 0.5) / 10000 AS gap FROM top t FULL JOIN seg s USING (query_id))"""


def _path(top: DataFrame, spark, sf_dir) -> DataFrame:
    return cohorts.path_signal(top.where("rank <= 15").groupBy("query_id").agg(*cohorts.outcome_counts()), _segments(spark, sf_dir), ["query_id"])


@query(f"WITH {PATH} SELECT * FROM sig")
def path_signal(spark, sf_dir):
    return _path(_outcomes(spark, sf_dir, 15), spark, sf_dir)


@query(f"WITH {PATH}, b AS (SELECT query_id, max(score) AS best FROM r GROUP BY query_id) SELECT query_id, CASE WHEN query_id % 300 = 0 THEN 'SHORT_INPUT' WHEN direction IN ('NEGATIVO', 'POSITIVO', 'NEUTRO', 'INCERTO') THEN direction WHEN best >= 70 THEN 'STRONG' WHEN best >= 50 THEN 'MODERATE' WHEN best >= 30 THEN 'WEAK' ELSE 'NONE' END AS verdict FROM sig JOIN b USING (query_id)")
def verdict_label(spark, sf_dir):
    """Verdicts; every third query stands for one whose input is too short."""
    top = stored(_outcomes(spark, sf_dir, 15), "best")
    best = top.groupBy("query_id").agg(F.max("score").alias("best"))
    return _path(top, spark, sf_dir).join(best, "query_id").select("query_id", cohorts.verdict_code(F.col("direction"), F.col("query_id") % 300 == 0, F.col("best")).alias("verdict"))


# Companies with texts, two macros and two categories each, and the priority of the last order as cause of the dead ones.
FULL = f"""{COMPANIES},
last AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY o_custkey),
full_company AS (
  SELECT company_id, name, coalesce(text, '') AS description, [category, lower(r_name)] AS macros, [category, country] AS categories, country, founded_year, outcome, n_orders,
    CASE WHEN outcome = 'dead' THEN regexp_replace(priority, '^[0-9]-', '') END AS cause, n_orders % 2 = 0 AS cause_inferred
  FROM company JOIN nation ON lower(n_name) = country JOIN region ON r_regionkey = n_regionkey JOIN last ON o_custkey = company_id
  LEFT JOIN (SELECT doc_id, any_value(text) AS text FROM documents GROUP BY doc_id) ON doc_id = company_id)"""


def full_companies(spark, sf_dir: str) -> DataFrame:
    rows = companies(spark, sf_dir)
    last = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("_p"))
    nations = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("country"), F.lower("r_name").alias("_r"))
    texts = load(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("company_id")).agg(F.first("text").alias("description"))
    rows = rows.join(last, "company_id").join(nations, "country").join(texts, "company_id", "left")
    return rows.withColumns(
        {
            "description": F.coalesce("description", F.lit("")),
            "macros": F.array("category", "_r"),
            "categories": F.array("category", "country"),
            "cause": F.when(F.col("outcome") == "dead", F.regexp_replace("_p", "^[0-9]-", "")),
            "cause_inferred": F.col("n_orders") % 2 == 0,
        }
    ).drop("_p", "_r")


_TOK = sql_tokens("description", lx.STOPWORDS)
_KEY = "list_transform({}, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'))"

EXHAUSTIVE = f"""{FULL},
c AS (SELECT *, {_KEY.format('categories')} AS keys, regexp_replace(lower(coalesce(cause, '')), '[^a-z0-9]+', '', 'g') AS cause_key FROM full_company),
tc AS (SELECT company_id, t AS term, count(*) AS n, any_value(total) AS total FROM (SELECT company_id, len(w) AS total, unnest(w) AS t FROM (SELECT company_id, {_TOK} AS w FROM c)) GROUP BY company_id, t),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM c)) / (count(*) + 1.0)) + 1.0 AS idf FROM tc GROUP BY term),
raw AS (SELECT company_id, term, n / total * idf AS raw FROM tc JOIN idf USING (term)),
post AS (SELECT company_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY company_id)) AS w FROM raw),
lexical AS (SELECT a.company_id AS query_id, b.company_id, sum(a.w * b.w) AS lex FROM post a JOIN post b USING (term) WHERE a.company_id % 100 = 0 GROUP BY ALL HAVING sum(a.w * b.w) >= 0.08),
p AS (
  SELECT q.company_id AS query_id, c.company_id, c.outcome,
    len(list_intersect(q.macros, c.macros)) / len(q.macros) AS macro, len(list_intersect(q.keys, c.keys)) / len(q.keys) AS category,
    least(coalesce(lex, 0), 1.0) AS lex, q.cause_key <> '' AND q.cause_key = c.cause_key AS same_cause, CASE WHEN c.cause_inferred THEN 16.0 ELSE 28.0 END AS cause_weight,
    contains(q.country, c.country) OR contains(c.country, q.country) AS near,
    CASE WHEN abs(q.founded_year - c.founded_year) <= 3 THEN 1 - pow(abs(q.founded_year - c.founded_year) / 4.0, 1.5) ELSE 0 END AS era
  FROM c q JOIN c ON q.company_id <> c.company_id LEFT JOIN lexical l ON l.query_id = q.company_id AND l.company_id = c.company_id WHERE q.company_id % 100 = 0),
s AS (SELECT *, outcome = 'dead' AND (macro >= 0.3)::INT + (category >= 0.3)::INT + (lex >= 0.3)::INT + same_cause::INT + near::INT + (era >= 0.3)::INT >= 4 AS convergence,
  16 * macro + 10 * category + 15 * lex + CASE WHEN same_cause THEN cause_weight ELSE 0 END + CASE WHEN near THEN 7 ELSE 0 END + 5 * era AS points FROM p),
best AS (
  SELECT query_id, company_id, convergence, points + CASE WHEN convergence THEN 20 ELSE 0 END AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(points + CASE WHEN convergence THEN 20 ELSE 0 END, 9) DESC, company_id) AS rank
  FROM s WHERE points + CASE WHEN convergence THEN 20 ELSE 0 END >= 18.0 QUALIFY rank <= 25)"""


@query(f"WITH {EXHAUSTIVE} SELECT query_id, company_id, rank, {round4('score')} AS score, convergence FROM best")
def consult_topk(spark, sf_dir):
    """The 25 best matches by texts, macros, categories, causes, countries and years, exactly, from kinds of companies and bounds of blocks."""
    rows = stored(full_companies(spark, sf_dir), "companies")
    best = consult.best_with_texts(_as_queries(rows.where(ASKED)), consult.Corpus(rows), 25, others=True)
    return best.select("query_id", "company_id", "rank", cl.round4(F.col("score")).alias("score"), "convergence")


def consult_run(spark, sf_dir):
    """A whole consultation of the companies that ask, from their texts to ranked, reranked and explained matches."""
    rows = stored(full_companies(spark, sf_dir), "companies").withColumn("headcount", F.col("n_orders").cast("string")).withColumn("founded_year", F.col("founded_year").cast("string"))
    none = F.lit(None).cast("string")
    asked = rows.where(ASKED).select(F.col("company_id").alias("query_id"), "name", F.col("description").alias("one_liner"), "categories", none.alias("model"), "country", "founded_year", F.col("headcount").alias("team_size"), none.alias("stage"), "cause", F.array().cast("array<string>").alias("secondary"))
    found = consult.consult(asked, rows, {m: [m] for m in ("automobile", "building", "furniture", "household", "machinery")})
    return found.withColumn("reasons", F.array_join("reasons", "|"))


query()(consult_run)


_SEG = f"""{FULL},
asked AS (SELECT company_id AS query_id, macros, cause FROM full_company WHERE {ASKED}),
inside AS (SELECT query_id, a.cause AS q_cause, c.* FROM asked a JOIN full_company c ON list_has_any(a.macros, c.macros))"""


def _ranked_list(value: str, where: str, k: int) -> str:
    return f"""(SELECT query_id, string_agg(value || ':' || n, '|' ORDER BY nth) AS told FROM (
      SELECT query_id, {value} AS value, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, {value}) AS nth FROM inside WHERE {where} GROUP BY query_id, {value} QUALIFY nth <= {k}) GROUP BY query_id)"""


@query(f"""
WITH {_SEG},
n AS (SELECT query_id, count(*) FILTER (outcome = 'operating') AS operating, count(*) FILTER (outcome = 'acquired') AS acquired, count(*) FILTER (outcome = 'dead') AS dead, count(*) FILTER (outcome = 'unknown') AS unknown, count(*) AS total,
  count(*) FILTER (coalesce(cause, '') = coalesce(q_cause, '')) AS matching FROM inside GROUP BY query_id)
SELECT n.*, coalesce(d.told, '') AS documented, coalesce(i.told, '') AS inferred, coalesce(k.told, '') AS countries
FROM n LEFT JOIN {_ranked_list('cause', 'cause IS NOT NULL AND NOT cause_inferred', 8)} d USING (query_id) LEFT JOIN {_ranked_list('cause', 'cause IS NOT NULL AND cause_inferred', 8)} i USING (query_id) LEFT JOIN {_ranked_list('country', 'country IS NOT NULL', 6)} k USING (query_id)
""")
def segment_report(spark, sf_dir):
    """Statistics of each query's segment: outcomes, companies of the same cause, documented and inferred causes, countries."""
    rows = full_companies(spark, sf_dir)
    out = segments.stats(rows.where(ASKED).withColumnRenamed("company_id", "query_id"), segments.cells(rows))
    told = {c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), "|") for c in ("documented", "inferred", "countries")}
    return out.withColumns(told)


@query(f"""
WITH {_SEG}, tc AS (SELECT company_id, t AS term, count(*) AS n, any_value(total) AS total FROM (SELECT company_id, len(w) AS total, unnest(w) AS t FROM (SELECT company_id, {_TOK} AS w FROM full_company)) GROUP BY company_id, t),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM full_company)) / (count(*) + 1.0)) + 1.0 AS idf FROM tc GROUP BY term),
raw AS (SELECT company_id, term, n / total * idf AS raw FROM tc JOIN idf USING (term)),
post AS (SELECT company_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY company_id)) AS w FROM raw),
side AS (SELECT query_id, company_id, outcome <> 'dead' AS alive FROM inside WHERE outcome <> 'unknown'),
size AS (SELECT query_id, count(*) FILTER (alive) AS living, count(*) FILTER (NOT alive) AS dead FROM side GROUP BY query_id),
sums AS (SELECT query_id, term, coalesce(sum(w) FILTER (alive), 0) AS w1, coalesce(sum(w) FILTER (NOT alive), 0) AS w0, count(*) FILTER (alive) AS n1, count(*) FILTER (NOT alive) AS n0 FROM side JOIN post USING (company_id) GROUP BY query_id, term),
gap AS (SELECT *, coalesce(w1 / nullif(living, 0), 0) - coalesce(w0 / nullif(dead, 0), 0) AS gap FROM sums JOIN size USING (query_id) WHERE length(term) >= 3),
told AS (SELECT query_id, 'survivors' AS side, term, n1 AS support, living AS size, gap AS delta FROM gap UNION ALL SELECT query_id, 'dead', term, n0, dead, -gap FROM gap)
SELECT query_id, side, row_number() OVER (PARTITION BY query_id, side ORDER BY round(delta, 9) DESC, term) AS rank, term, support, {round4('delta')} AS delta FROM told WHERE delta > 0 AND support >= greatest(3, size // 12) QUALIFY rank <= 10
""")
def segment_contrast(spark, sf_dir):
    """Terms that tell the survivors of each query's segment from its dead, and the other way."""
    from peerlens.operators import textindex

    rows = stored(full_companies(spark, sf_dir), "companies")
    counts, idf = textindex.index(rows, "company_id", "description")
    found = segments.contrast(rows.where(ASKED).withColumnRenamed("company_id", "query_id"), rows, textindex.weighted(counts, idf, "company_id"))
    return found.withColumn("delta", cl.round4(F.col("delta")))


@query(f"""
WITH k(macro, kw) AS (VALUES {values([(m, w) for m, ws in lx.LITE_MACROS.items() for w in ws])}),
words AS (SELECT DISTINCT unnest(string_split(lower(coalesce(text, '')), ' ')) AS w FROM documents UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT p_type FROM part),
c AS (SELECT w AS category, translate(lower(trim(w, ' ')), '{lx.ACCENTED}', '{lx.FOLDED}') AS key FROM words)
SELECT category, array_to_string(list_sort(list(DISTINCT macro)), '|') AS macros FROM c JOIN k ON contains(key, kw) OR contains(kw, key) WHERE key <> '' GROUP BY category
""")
def category_macros(spark, sf_dir):
    """Macros of all words of documents and all types of parts, taken for categories: keyword in category or category in keyword."""
    words = load(spark, sf_dir, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), " ")).alias("category"))
    types = load(spark, sf_dir, "part").select(F.explode(F.array(F.lower("p_type"), "p_type")).alias("category"))
    found = containment.category_macros(words.unionByName(types), "category", containment.keyword_table(spark, lx.LITE_MACROS))
    return found.withColumn("macros", F.array_join("macros", "|"))
