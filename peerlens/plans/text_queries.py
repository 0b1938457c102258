"""Queries over texts: tokens, TF-IDF, fuzzy words, extraction and quality."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.functions import text as tx
from peerlens.operators import quality, scoring, textindex
from peerlens.sources.sinks import stored

from .analogs import round4, sql_tokens
from .registry import load, query, values

TOK = sql_tokens("text", lx.STOPWORDS)

INDEX = f"""
tc AS (SELECT doc_id, t AS term, count(*) AS n, any_value(total) AS total FROM (SELECT doc_id, len(w) AS total, unnest(w) AS t FROM (SELECT doc_id, {TOK} AS w FROM documents)) GROUP BY doc_id, t),
idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM documents)) / (count(*) + 1.0)) + 1.0 AS idf FROM tc GROUP BY term),
raw AS (SELECT doc_id, term, n / total * idf AS raw FROM tc JOIN idf USING (term)),
post AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM raw)"""

TOPK = f"""{INDEX},
qc AS (SELECT item_id, t AS term, count(*) AS n, any_value(total) AS total FROM (SELECT item_id, len(w) AS total, unnest(w) AS t FROM (SELECT item_id, {TOK} AS w FROM benchmark)) GROUP BY item_id, t),
qraw AS (SELECT item_id, term, n / total * idf AS raw FROM qc JOIN idf USING (term)),
q AS (SELECT item_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)) AS wq FROM qraw),
scored AS (SELECT item_id, doc_id, sum(wq * w) AS score FROM q JOIN post USING (term) GROUP BY item_id, doc_id HAVING sum(wq * w) >= 0.08),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)"""


def _top(spark, sf_dir):
    return textindex.cosine_topk(load(spark, sf_dir, "benchmark"), "item_id", load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(f"WITH {TOPK} SELECT item_id, doc_id, {round4('score')} AS score, rank FROM top")
def tfidf_topk(spark, sf_dir):
    return _top(spark, sf_dir).withColumn("score", cl.round4(F.col("score")))


@query(f"""
WITH {TOPK}, t AS (SELECT item_id, doc_id, term, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY round(wq * w, 9) DESC, term DESC) AS n FROM top JOIN q USING (item_id) JOIN post USING (doc_id, term))
SELECT item_id, doc_id, array_to_string(list(term ORDER BY n), '|') AS terms FROM t WHERE n <= 5 GROUP BY item_id, doc_id
""")
def shared_terms(spark, sf_dir):
    """The terms that explain each of an item's ten closest documents."""
    items, docs = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents").select("doc_id", "text")
    counts, idf = textindex.index(docs, "doc_id")
    top = stored(textindex.cosine_topk(items, "item_id", docs, "doc_id", indexed=(counts, idf)), "top")
    counts = counts.join(top.select("doc_id").distinct(), "doc_id", "left_semi")  # only documents that are told of are weighed
    asked = textindex.weighted(textindex.term_counts(items, "item_id", "text"), idf, "item_id").withColumnRenamed("w", "wq")
    rows = textindex.shared_terms(top, asked, textindex.weighted(counts, idf, "doc_id"), "item_id", "doc_id")
    return rows.withColumn("terms", F.array_join("terms", "|"))


@query(f"WITH {INDEX} SELECT term, df, {round4('idf')} AS idf FROM idf")
def tfidf_idf_table(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return textindex.idf_table(textindex.term_counts(docs, "doc_id", "text"), docs.count()).select("term", "df", cl.round4(F.col("idf")).alias("idf"))


@query(f"SELECT doc_id, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS distinct_tokens FROM (SELECT doc_id, {TOK} AS w FROM documents)")
def tokenize_counts(spark, sf_dir):
    w = tx.tokens(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("tokens"), F.size(F.array_distinct(w)).cast("long").alias("distinct_tokens"))


_NEGATION = ", ".join(f"'{m}'" for m in dict.fromkeys(m.replace("'", "''") for m in lx.NEGATION_MARKERS))


@query(f"""
WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM conversations),
step AS (
  SELECT conv_id, turn, w, 0 AS i, 0 AS skip, []::VARCHAR[] AS o FROM w
  UNION ALL
  SELECT conv_id, turn, w, i + 1,
    CASE WHEN skip > 0 THEN skip - 1 WHEN b IN ({_NEGATION}) OR ends_with(b, 'n''t') THEN {lx.NEGATION_WINDOW} ELSE 0 END,
    CASE WHEN skip > 0 OR b IN ({_NEGATION}) OR ends_with(b, 'n''t') THEN o ELSE list_append(o, w[i + 1]) END
  FROM (SELECT *, regexp_replace(w[i + 1], '[^a-z0-9'']', '', 'g') AS b FROM step WHERE i < len(w)))
SELECT conv_id, turn, array_to_string(o, ' ') AS kept FROM step WHERE i = len(w)
""")
def negation_strip(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.strip_negated(F.col("text")).alias("kept"))


PHRASES = {"of the": "ofthe", "in the": "inthe"}
DICTIONARY = {"and": "plus also", "thing": "object", "nicht": "not", "avec": "with"}


@query(f"""
WITH d AS (SELECT doc_id, replace(replace(lower(text), 'of the', 'ofthe'), 'in the', 'inthe') AS t FROM documents),
m(k, v) AS (VALUES {values(list(DICTIONARY.items()))}),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(coalesce(t, '')), '{lx.ACCENTED}', '{lx.FOLDED}'), '[a-z][a-z0-9]{{2,}}')) AS t FROM d),
x AS (SELECT doc_id, unnest(string_split(coalesce(v, t), ' ')) AS t FROM w LEFT JOIN m ON k = t)
SELECT t AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY t
""")
def multiword_translate(spark, sf_dir):
    words = tx.translated(tx.tokens(tx.replaced_phrases(F.lower("text"), PHRASES), []), DICTIONARY)
    docs = load(spark, sf_dir, "documents")
    if not textindex.repeated(docs, "doc_id"):  # counted within each document, so that no pair of a word and a document is shuffled
        rows = docs.select("doc_id", words.alias("_w")).select("doc_id", F.explode(textindex.counted(F.col("_w"))).alias("t"))
        return rows.groupBy(F.col("t.term").alias("word")).agg(F.sum("t.n").alias("n"), F.count("doc_id").alias("docs"))
    rows = docs.select("doc_id", F.explode(words).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"""
WITH v AS (SELECT t AS term, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest({sql_tokens('p_name', ['zzz'])}) AS t FROM part) GROUP BY t),
w AS (SELECT DISTINCT left(term, length(term) - 1) || 'x' AS word FROM v WHERE length(term) >= 5),
m AS (SELECT word, term, df FROM w JOIN v ON left(word, 1) = left(term, 1) AND abs(length(word) - length(term)) <= 1 AND length(term) >= 4
  WHERE damerau_levenshtein(word, term) <= 1 AND word NOT IN (SELECT term FROM v))
SELECT word, arg_min(term, (-df, term)) AS correction FROM m GROUP BY word
""")
def fuzzy_vocab_match(spark, sf_dir):
    names = load(spark, sf_dir, "part").select("p_partkey", F.explode(tx.tokens(F.col("p_name"), [])).alias("term"))
    vocabulary = names.groupBy("term").agg(F.countDistinct("p_partkey").alias("df"))
    words = vocabulary.where(F.length("term") >= 5).select(F.concat(F.expr("left(term, length(term) - 1)"), F.lit("x")).alias("word"))
    return textindex.fuzzy_corrections(words, vocabulary)


_ALL = f"SELECT doc_id, unnest({sql_tokens('text', [])}) AS t FROM documents"


@query(f"""
WITH n AS (SELECT t AS term, count(DISTINCT doc_id) AS df FROM ({_ALL}) GROUP BY t),
x AS (SELECT term, df, unnest(list_distinct(list_append(list_transform(range(1, length(term) + 1), lambda i: left(term, i - 1) || substring(term, i + 1)), term))) AS part FROM n),
m AS (SELECT w.term AS word, v.term AS term, v.df AS df FROM x w JOIN x v USING (part)
  WHERE w.df = 1 AND v.df > 1 AND length(w.term) >= 5 AND length(v.term) >= 4 AND left(w.term, 1) = left(v.term, 1) AND damerau_levenshtein(w.term, v.term) <= 1)
SELECT word, arg_min(term, (-df, term)) AS correction FROM m GROUP BY word
""")
def fuzzy_document_words(spark, sf_dir):
    """Words that one document uses, by the word within one edit that several use; all words of documents."""
    words = load(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"), [])).alias("term"))
    counts = stored(words.groupBy("term").agg(F.countDistinct("doc_id").alias("df")), "words")
    return textindex.fuzzy_corrections(counts.where("df = 1").select(F.col("term").alias("word")), counts.where("df > 1"))


CAUSES = {"Lack of Funds": ["ran out of", "funds", "cash"], "Competition": ["lost to", "other", "tion"], "Bad Timing": ["too early", "then", "late"], "Poor Product": ["bug", "thing"]}


def _cause_sql() -> str:
    n = {c: " + ".join(f"contains(t, '{p}')::INT" for p in ps) for c, ps in CAUSES.items()}
    rows = " UNION ALL ".join(f"SELECT doc_id, len_ok, '{c}' AS cause, {k} AS ord, {n[c]} AS n FROM d" for k, c in enumerate(CAUSES))
    return f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, length(lower(coalesce(text, ''))) >= 20 AS len_ok FROM documents),
h AS (SELECT * FROM ({rows}) WHERE n > 0 AND len_ok),
g AS (SELECT doc_id, count(*) AS causes, arg_max(cause, (n, -ord)) AS best, max(n) AS most FROM h GROUP BY doc_id)
SELECT doc_id, CASE WHEN causes >= 3 THEN 'Multiple Reasons' ELSE best END AS cause,
  CASE WHEN causes >= 3 THEN 'medium' WHEN most >= 2 THEN 'high' ELSE 'low' END AS confidence FROM g"""


@query(_cause_sql())
def cause_lexicon(spark, sf_dir):
    c = cl.infer_cause(F.col("text"), CAUSES)
    return load(spark, sf_dir, "documents").select("doc_id", F.inline_outer(F.array(c))).where("cause is not null").select("doc_id", "cause", "confidence")


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(re.sub(r"([.$])", r"[\1]", w).replace(" ", "[ ]+") for w in sorted(words, key=len, reverse=True)) + ")"


_MONEY = f"(?i){_any(lx.CURRENCIES)}\\s*([0-9][0-9.,]*)(?:\\s*({_any(list(lx.MONEY_UNITS))})(?:[^\\pL0-9]|$))?"
_ROUND = f"(?i)(?:^|[^\\pL0-9])({_any(lx.ROUND_WORDS)}|{_any(lx.ROUND_SERIES)}\\s?[a-f])(?:[^\\pL0-9]|$)"
_YEAR = "\\b(19[0-9]{2}|20[0-3][0-9])\\b"
_STAFF = f"(?i)\\b([0-9]{{1,4}})\\s*{_any(lx.STAFF_WORDS)}(?:[^\\pL0-9]|$)"

# Forms of money, rounds, years and staff, told of every order, behind the text of the document of its customer.
FORMS = ["raised US$ {n},5 million in a Series B, 1998", "levantamos R$ {n}.000 mil em rodada série f; 12 funcionários", "usd {n} mm seed; {n} devs", "€{n}bn, ipo 2041, 2039", "GBP {n} milhões anjo {n} staff", "nothing {n} here, pre seed 2005 and 1999", "bootstrapped, u$s {n}k, {n} colabs", "£{n} billion revenue-based 20015", "brl {n} bilhão, seedling, {n} people"]


@query(f"""
WITH f(k, s) AS (VALUES {values(list(enumerate(FORMS)))}), u(unit, factor) AS (VALUES {values(list(lx.MONEY_UNITS.items()))}),
t AS (SELECT o_orderkey, replace(s, '{{n}}', (o_orderkey % 97)::VARCHAR) || ' | ' || left(coalesce(text, ''), 300) AS t FROM orders JOIN f ON k = o_orderkey % {len(FORMS)} LEFT JOIN (SELECT doc_id, min(text) AS text FROM documents GROUP BY doc_id) ON doc_id = o_custkey),
x AS (SELECT *, regexp_extract_all(t, '{_YEAR}', 1) AS y, regexp_extract(t, '{_MONEY}', 1) AS n, lower(regexp_extract(t, '{_MONEY}', 2)) AS unit FROM t)
SELECT o_orderkey, list_min(list_transform(y, lambda v: v::INT)) AS least_year, len(list_distinct(y))::INT AS years, nullif(lower(regexp_extract(t, '{_ROUND}', 1)), '') AS round,
  try_cast(nullif(regexp_extract(t, '{_STAFF}', 1), '') AS INT) AS headcount, try_cast(replace(replace(nullif(n, ''), '.', ''), ',', '.') AS DOUBLE) * coalesce(factor, 1.0) AS money
FROM x LEFT JOIN u USING (unit)
""")
def entity_forms(spark, sf_dir):
    """Money, rounds, years and staff in all the forms there are lists for."""
    docs = load(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("o_custkey")).agg(F.min("text").alias("text"))
    form = F.get(F.array(*[F.lit(s) for s in FORMS]), (F.col("o_orderkey") % len(FORMS)).cast("int"))
    told = F.concat(F.replace(form, F.lit("{n}"), (F.col("o_orderkey") % 97).cast("string")), F.lit(" | "), F.left(F.coalesce("text", F.lit("")), F.lit(300)))
    rows = load(spark, sf_dir, "orders").join(docs, "o_custkey", "left").select("o_orderkey", cl.entities(told).alias("e"))
    return rows.select("o_orderkey", F.col("e.year").alias("least_year"), F.size("e.years").alias("years"), "e.round", "e.headcount", "e.money")


@query(f"""
WITH u(unit, factor) AS (VALUES {values(list(lx.MONEY_UNITS.items()))}),
t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT doc_id + 1000000, 0, coalesce(text, '') FROM documents),
x AS (SELECT *, regexp_extract_all(t, '{_YEAR}', 1) AS y, regexp_extract(t, '{_MONEY}', 1) AS n, lower(regexp_extract(t, '{_MONEY}', 2)) AS unit FROM t)
SELECT conv_id, turn,
  list_min(list_transform(y, lambda x: x::INT)) AS least_year, len(list_distinct(y))::INT AS years, nullif(lower(regexp_extract(t, '{_ROUND}', 1)), '') AS round,
  try_cast(replace(replace(nullif(n, ''), '.', ''), ',', '.') AS DOUBLE) * coalesce(factor, 1.0) AS money
FROM x LEFT JOIN u USING (unit)
""")
def money_extract(spark, sf_dir):
    texts = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(load(spark, sf_dir, "documents").select((F.col("doc_id") + 1000000).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text"))
    e = F.col("e")
    return texts.select("conv_id", "turn", cl.entities(F.col("text")).alias("e")).select("conv_id", "turn", e["year"].alias("least_year"), F.size(e["years"]).alias("years"), e["round"].alias("round"), e["money"].alias("money"))


@query(f"""
WITH s AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN 'series a' END AS declared FROM conversations)
SELECT conv_id, turn, coalesce(nullif(trim(declared), ''), nullif(lower(regexp_extract(coalesce(text, ''), '{_ROUND}', 1)), '')) AS stage,
  try_cast(nullif(regexp_extract(coalesce(text, ''), '{_YEAR}', 1), '') AS INT) IS NOT NULL AS found_year FROM s
""")
def slot_fill(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("declared", F.when(F.col("turn") % 2 == 0, "series a"))
    e = cl.entities(F.col("text"))
    return rows.select("conv_id", "turn", F.coalesce(tx.absent(F.col("declared")), e["round"]).alias("stage"), e["year"].isNotNull().alias("found_year"))


@query(f"""
WITH b AS (SELECT item_id, text, {TOK} AS w FROM benchmark)
SELECT item_id, len(list_distinct(w))::INT AS distinct_words, CASE WHEN len(list_distinct(w)) < 5 THEN 0.4 WHEN len(list_distinct(w)) < 10 THEN 0.7 ELSE 1.0 END::DOUBLE AS trust,
  len(list_distinct(w)) < 5 AS short, ((len(list_distinct(w)) < 5)::INT + (length(coalesce(text, '')) < 30)::INT) AS warnings,
  list_has_any(w, ['thing', 'ther']) AS coherent FROM b
""")
def input_quality(spark, sf_dir):
    w = tx.tokens(F.col("text"))
    rows = load(spark, sf_dir, "benchmark").select("item_id", scoring.input_quality(w, F.col("text")).alias("q"), scoring.coherent(w, F.array(F.lit("thing"), F.lit("ther"))).alias("coherent"))
    return rows.select("item_id", F.col("q.distinct").alias("distinct_words"), "q.trust", "q.short", F.size("q.warnings").alias("warnings"), "coherent")


@query(f"""
WITH {INDEX}, g AS (SELECT doc_id, toxic = 1 AS positive FROM labels WHERE toxic IS NOT NULL),
s AS (SELECT term, sum(CASE WHEN positive THEN w ELSE 0 END) AS sp, sum(CASE WHEN positive THEN 0 ELSE w END) AS sn, count(*) FILTER (positive) AS support FROM post JOIN g USING (doc_id) GROUP BY term),
n AS (SELECT count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nn FROM g)
SELECT term, support, {round4('sp / np - sn / nn')} AS delta FROM s, n WHERE support >= greatest(3, floor(np / 12)) AND length(term) >= 3 AND sp / np - sn / nn > 0
ORDER BY round(sp / np - sn / nn, 9) DESC, term LIMIT 10
""")
def contrastive_terms(spark, sf_dir):
    counts, idf = textindex.index(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    groups = load(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", (F.col("toxic") == 1).alias("positive"))
    # only documents of either group are weighed
    postings = textindex.weighted(counts.join(groups, "doc_id", "left_semi"), idf, "doc_id")
    return textindex.contrastive_terms(postings, "doc_id", groups).withColumn("delta", cl.round4(F.col("delta")))


@query(f"""
WITH {TOPK}, truth AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
e AS (SELECT item_id, count(*) AS expected FROM truth GROUP BY item_id),
h AS (SELECT item_id, min(rank) AS first, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10 FROM truth JOIN top USING (item_id, doc_id) GROUP BY item_id)
SELECT item_id, expected, {round4('coalesce(h5, 0) / least(5, expected)')} AS p_at_5, {round4('coalesce(h10, 0) / least(10, expected)')} AS p_at_10,
  {round4('coalesce(h10, 0) / expected')} AS recall_at_10, {round4('coalesce(1.0 / first, 0.0)')} AS reciprocal_rank FROM e LEFT JOIN h USING (item_id)
""")
def ir_metrics(spark, sf_dir):
    items, docs = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents").select("doc_id", "text")
    counts, idf = textindex.index(docs, "doc_id")
    truth = textindex.containing(items, "item_id", docs, "doc_id", counts, idf)
    return quality.ir_metrics(textindex.cosine_topk(items, "item_id", docs, "doc_id", indexed=(counts, idf)), truth, "item_id", "doc_id")


@query("""
WITH x AS (SELECT text, lang, source, toxic::VARCHAR AS toxic, quality::VARCHAR AS quality FROM documents LEFT JOIN labels USING (doc_id)),
r AS (UNPIVOT (SELECT count(*) FILTER (nullif(trim(text), '') IS NOT NULL) AS text, count(*) FILTER (nullif(trim(lang), '') IS NOT NULL) AS lang,
  count(*) FILTER (nullif(trim(source), '') IS NOT NULL) AS source, count(toxic) AS toxic, count(quality) AS quality FROM x) ON text, lang, source, toxic, quality INTO NAME field VALUE filled)
SELECT field, filled, (SELECT count(*) FROM x) AS total, floor(filled / (SELECT greatest(count(*), 1) FROM x) * 10000 + 0.5) / 10000 AS rate FROM r
""")
def quality_fill_rates(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.fill_rates(rows, ["text", "lang", "source", "toxic", "quality"])


PAYWALL = ["apache license", "all rights reserved"]


@query("""
SELECT lang, count(*) FILTER (k = 'real') AS "real", count(*) FILTER (k = 'pro_only') AS pro_only, count(*) FILTER (k = 'weak') AS weak, count(*) FILTER (k = 'empty') AS "empty", list_sort(list(n))[len(list(n)) // 2 + 1] AS median_chars
FROM (SELECT lang, length(coalesce(text, '')) AS n, CASE WHEN nullif(trim(text), '') IS NULL THEN 'empty' WHEN contains(lower(text), 'apache license') OR contains(lower(text), 'all rights reserved') THEN 'pro_only' WHEN length(trim(text)) < 40 THEN 'weak' ELSE 'real' END AS k FROM documents) GROUP BY lang
""")
def section_kind_pivot(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), quality.section_kind(F.col("text"), PAYWALL).alias("k"))
    kinds = rows.groupBy("lang").agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("real", "pro_only", "weak", "empty")])
    return kinds.join(quality.upper_median(rows, "lang", "n", "median_chars"), "lang")
