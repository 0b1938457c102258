"""Consultation: a table of queries against a table of companies, from raw text to ranked, explained matches.

Queries: query_id, name, one_liner, categories (array), model, country, founded_year, team_size, stage, cause,
secondary (array). Companies: company_id, name, description, categories (array), macros (array), country, founded_year,
headcount, status, cause, cause_inferred, and optionally embedding on both sides. One plan serves one query or
ten thousand: queries meet blocks of companies by what they have in common, and only blocks that can reach the best scores are scored.
The table of macros (macro -> keywords) is a dictionary or a table (macro, keyword).

What a query declares is held against its text: a declared model without any of its words in the text scores nothing, a declared cause
without any of its words counts 0.6, and a segment of few peers lowers the weight of the embedding and the confidence.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.functions import text as tx
from peerlens.operators import cohorts, containment, retrieval, scoring, segments, textindex, vectors
from peerlens.sources.sinks import stored

#: Queries that one plan broadcasts at most; more are taken in blocks of this size.
BLOCK = 1_000


def analyzed(queries: DataFrame, macros: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    """Queries with empty slots filled from their text, their words, quality and keys."""
    text = F.concat_ws(" ", "name", "one_liner")
    e = cl.entities(text)
    q = queries.withColumns(
        {
            "stage": F.coalesce(tx.absent(F.col("stage")), e["round"]),
            "founded_year": F.coalesce(tx.absent(F.col("founded_year")), e["year"].cast("string")),
            "team_size": F.coalesce(tx.absent(F.col("team_size")), e["headcount"].cast("string")),
            "total_funding": F.coalesce(tx.absent(F.col("total_funding")) if "total_funding" in queries.columns else F.lit(None), e["money"].cast("decimal(20,0)").cast("string")),
            "words": tx.tokens(tx.strip_negated(F.lower(text))),
            "country_key": tx.country_key(F.col("country"), lx.COUNTRY_ALIASES),
            "category_keys": F.filter(F.transform("categories", tx.compact_key), lambda c: c != ""),
            "macros": F.array().cast("array<string>"),
        }
    )
    if macros is not None:
        keywords = containment.keyword_table(queries.sparkSession, macros) if isinstance(macros, dict) else macros
        q = containment.with_macros(q, keywords)
    q = q.withColumn("quality", scoring.input_quality(F.col("words"), F.col("one_liner")))
    return q.withColumn("year", cl.leading_year(F.col("founded_year")))


def corrected(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Queries whose words that no company uses are replaced by the word within one edit that companies use; vocabulary: term, df."""
    words = queries.select("query_id", F.posexplode("words").alias("at", "word"))
    fixed = textindex.fuzzy_corrections(words.select("word"), vocabulary)
    rows = words.join(fixed, "word", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("correction", "word").alias("word")))).alias("_w"))
    return queries.join(rows, "query_id", "left").withColumn("words", F.coalesce(F.transform("_w", lambda x: x["word"]), "words")).drop("_w")


def _expected(declared: Column, table: dict[str, list[str]]) -> Column:
    """Words that go with what is declared, none if the table doesn't know it."""
    none = F.array().cast("array<string>")
    if not table:
        return none
    known = F.create_map(*[x for k, ws in table.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in ws]))])
    return F.coalesce(F.element_at(known, declared), none)


def coherence(queries: DataFrame, models: dict[str, list[str]] | None = None, causes: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds coherent (the text has a word of the declared model) and corroborated (a word of the declared cause); true where nothing is expected or said.

    models: model in lower case -> words; causes: cause -> phrases, of which words of three letters or more count; both default to the fixed lists.
    """
    said = F.size("words") > 0
    models, causes = lx.MODEL_WORDS if models is None else models, lx.CAUSE_LEXICON if causes is None else causes
    pieces = {c: sorted({w for p in phrases for w in p.split() if len(w) >= 3 and w not in lx.STOPWORDS}) for c, phrases in causes.items()}
    model = _expected(F.lower(F.trim(F.coalesce("model", F.lit("")))), models)
    cause = _expected(F.coalesce("cause", F.lit("")), {c: ws for c, ws in pieces.items() if ws})
    return queries.withColumns({"coherent": ~said | scoring.coherent(F.col("words"), model), "corroborated": ~said | scoring.coherent(F.col("words"), cause)})


def segment_trust(queries: DataFrame, companies_cells: DataFrame) -> DataFrame:
    """Adds segment_trust: 0.5 below 10 companies that share a macro with the query, 0.75 below 20, else 1; 1 for a query without macros. companies_cells: segments.cells()."""
    counts = segments.outcomes(segments.of_queries(queries, companies_cells)).select("asked", F.col("total").alias("_peers"))
    n = F.coalesce("_peers", F.lit(0))
    trust = F.when(F.size("macros") == 0, 1.0).otherwise(cohorts.segment_trust(n))
    return queries.withColumn("asked", segments.signature(F.col("macros"))).join(counts, "asked", "left").withColumn("segment_trust", trust).drop("asked", "_peers")


class Corpus:
    """Companies made ready for queries: laid in blocks, with postings, vectors and the inverted file over blocks, each stored once, when it is asked for.

    Without a text column there are no postings, and matches have no lexical dimension.
    """

    def __init__(self, companies: DataFrame, key: str = "company_id", text: str | None = "description"):
        self.key = key
        self.rows = retrieval.laid(companies, key, text)
        self.idf = self.counts = None
        if text:
            self.counts, self.idf = textindex.index(self.rows, "place", text)

    @cached_property
    def postings(self) -> DataFrame | None:
        if self.idf is not None:
            return stored(textindex.weighted(self.counts, self.idf, "place").withColumn("block", retrieval.block_of()), "postings")

    @cached_property
    def file(self) -> DataFrame:
        return stored(retrieval.entries(self.rows, self.postings), "entries")

    @cached_property
    def blocks(self) -> DataFrame:
        return stored(retrieval.blocks(self.rows, self.key), "blocks")

    @cached_property
    def numbers(self) -> DataFrame:
        """idf with a number (id) for each term."""
        return stored(self.idf.withColumn("id", F.monotonically_increasing_id()), "numbers")

    @cached_property
    def vectors(self) -> DataFrame:
        """place, ids, ws: companies with words as sparse vectors of unit length."""
        return stored(textindex.vectors(self.counts, self.numbers, "place"), "vectors")


_KEPT = ["macros", "category_keys", "country_key", "year", "quality", "stage", "team_size", "coherent", "corroborated", "segment_trust"]


class Asked:
    """Queries of analyzed() (and coherence(), segment_trust()) against a corpus: bounds of blocks, scores of chosen blocks, explained matches."""

    def __init__(self, queries: DataFrame, corpus: Corpus, terms: bool = True):
        given = {"coherent": F.lit(True), "corroborated": F.lit(True), "segment_trust": F.lit(1.0)}
        queries = queries.withColumns({c: x for c, x in given.items() if c not in queries.columns})
        self.dense = "embedding" in queries.columns and "embedding" in corpus.rows.columns
        self.corpus = corpus
        none = F.array().cast("array<string>")
        keys = {"q_model_key": tx.compact_key(F.col("model")), "q_cause_key": tx.compact_key(F.col("cause")), "q_secondary_keys": F.filter(F.array_distinct(F.transform(F.coalesce("secondary", none), tx.compact_key)), lambda c: c != "")}
        kept = [F.col(c).alias(f"q_{c}") for c in [*_KEPT, *(["embedding"] if self.dense else [])]]
        self.rows = stored(queries.select("query_id", *kept, *[x.alias(c) for c, x in keys.items()]), "asked")
        self.terms = None
        if corpus.idf is None or not terms:
            return
        words = queries.select("query_id", F.size("words").alias("total"), F.explode("words").alias("term")).groupBy("query_id", "total", "term").agg(F.count("*").alias("n"))
        self.terms = stored(textindex.weighted(words, corpus.idf, "query_id").withColumnRenamed("w", "wq"), "asked-terms")

    def bounds(self) -> DataFrame:
        keys = retrieval.asked_keys(self.rows, self.corpus.rows, self.terms)
        trust = F.col("q_quality.trust") * F.col("q_segment_trust")
        dense = retrieval.dense_bounds(self.rows, self.corpus.rows, trust, BLOCK) if self.dense else None
        return stored(retrieval.bounds(keys, self.corpus.file, self.corpus.blocks, dense), "reachable")

    def _scored(self, chosen: DataFrame, by: str, rows: DataFrame) -> DataFrame:
        """chosen (query_id, and block or place) with rows of the corpus, dimensions and score."""
        pairs = chosen.join(self.rows, "query_id").join(rows, by)
        if self.terms is None:
            return self._with_score(pairs.withColumn("lexical", F.lit(None).cast("double")))
        met = chosen.join(self.terms, "query_id").join(self.corpus.postings, [by, "term"])
        lexical = met.groupBy("query_id", "place").agg(F.sum(F.col("wq") * F.col("w")).alias("lexical")).where(F.col("lexical") >= lx.MIN_LEXICAL)
        return self._with_score(pairs.join(lexical, ["query_id", "place"], "left"))

    def of_pairs(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """pairs (query_id, place, lexical) with rows of the corpus, dimensions and score."""
        return self._with_score(pairs.join(self.rows, "query_id").join(rows, "place"))

    def _with_score(self, pairs: DataFrame) -> DataFrame:
        dims: list[Column] = [
            scoring.overlap("macro", F.col("q_macros"), F.col("macros"), lx.WEIGHTS["macro"]),
            scoring.overlap("category", F.col("q_category_keys"), F.col("c_keys"), lx.WEIGHTS["category"]),
            scoring.dimension("model", F.lit(1.0), lx.WEIGHTS["model"], F.col("q_coherent") & (F.col("q_model_key") != "") & F.array_contains("c_keys", F.col("q_model_key"))),
            scoring.lexical(F.col("lexical")),
            scoring.cause(F.col("q_cause_key"), F.col("c_cause"), F.coalesce("cause_inferred", F.lit(False)), F.col("q_corroborated")),
            scoring.secondary(F.col("q_secondary_keys"), F.col("c_cause")),
            scoring.country(F.col("q_country_key"), F.col("c_country")),
            scoring.era(F.col("q_year"), F.col("c_year")),
        ]
        if self.dense:
            dims.append(scoring.semantic(vectors.dot(F.col("q_embedding"), F.col("embedding")), F.col("q_quality.trust") * F.col("q_segment_trust")))
        return scoring.with_score(pairs, dims, F.col("c_dead"))

    def scored(self, chosen: DataFrame) -> DataFrame:
        """query_id, place, company, score of all rows in chosen (query_id, block)."""
        needed = ["place", self.corpus.key, "macros", "c_keys", "c_cause", "cause_inferred", "c_country", "c_year", "c_dead", *(["embedding"] if self.dense else [])]
        rows = self.corpus.rows.select(*needed, retrieval.block_of().alias("block"))
        return self._scored(chosen, "block", rows).select("query_id", "place", self.corpus.key, "score")

    def explained(self, found: DataFrame) -> DataFrame:
        """Matches (query_id, place, rank) with all columns of the company, dimensions, score and convergence."""
        ranks = found.select("query_id", "place", "rank")
        return self._scored(ranks.select("query_id", "place"), "place", self.corpus.rows).join(ranks, ["query_id", "place"])

    def ranked(self, k: int) -> DataFrame:
        """query_id, place, company, score, rank of the k best companies of each query, exactly; blocks that can't reach them are not scored."""
        return stored(retrieval.best(self.bounds(), self.scored, k, self.corpus.key), "best")

    def best(self, k: int) -> DataFrame:
        """ranked() with all columns of the company, dimensions and convergence."""
        return self.explained(self.ranked(k))


def scored(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """All pairs from the least score on, with dimensions, score and rank; blocks that can't reach it are not scored."""
    asked = Asked(queries, Corpus(companies))
    return asked.explained(scoring.ranked(asked.scored(asked.bounds().select("query_id", "block"))))


#: All that a score without text and vectors depends on, in companies and in analyzed queries.
COMPANY_KIND = ["macros", "categories", "country", "founded_year", "cause", "cause_inferred", "status"]
QUERY_KIND = ["macros", "category_keys", "model", "country_key", "year", "cause", "secondary"]


def best_by_kinds(queries: DataFrame, companies: DataFrame, k: int, key: str = "company_id", others: bool = False) -> DataFrame:
    """Asked.best() without text and vectors, for companies and queries of which many are alike: kinds of queries meet kinds of companies.

    A kind of companies stands in the search for its least key. The k best kinds hold the k best companies, as any company of another kind is
    behind the least of each of these; of a kind, the first k companies by key are enough. So the search grows with kinds, and what is
    joined to queries and companies with k rows each. others: queries are companies themselves (query_id is their key) and don't match themselves.
    """
    ahead = k + int(others)
    given = {"coherent": F.lit(True), "corroborated": F.lit(True)}
    queries = queries.withColumns({c: x for c, x in given.items() if c not in queries.columns})
    kind = [*QUERY_KIND, *given]
    mine = queries.select("query_id", F.col("team_size").alias("q_team_size"), F.struct(*kind).alias("asked"))
    free = ["quality", "stage", "team_size"]  # not scored
    asked = stored(queries.groupBy(F.struct(*kind).alias("asked")).agg(F.min("query_id").alias("query_id"), *[F.any_value(c).alias(c) for c in free]), "asked-kinds")
    held = companies.withColumn("kind", F.struct(*COMPANY_KIND))
    corpus = Corpus(held.groupBy("kind").agg(F.min(key).alias(key)).select("kind.*", "kind", key), key, text=None)
    found = Asked(asked.select("asked.*", "query_id", *free), corpus).best(ahead)
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(key))
    members = held.drop(*[c for c in found.columns if c not in ("kind", key)]).withColumn("_nth", nth).where(F.col("_nth") <= ahead)
    # before the nth company of the kind of rank r there are r - 1 least companies and n - 1 of its own
    met = found.drop(key, "place", "q_team_size").join(members, "kind").where(F.col("rank") + F.col("_nth") <= ahead + 1)
    ranked = scoring.ranked(met, "query_id", key).where(F.col("rank") <= ahead).drop("kind", "_nth").withColumnRenamed("query_id", "_kind")
    rows = mine.join(asked.select("asked", F.col("query_id").alias("_kind")), "asked").drop("asked").join(ranked, "_kind").drop("_kind")
    if not others:
        return rows
    rest = rows.where(F.col(key) != F.col("query_id")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return rest.where(F.col("rank") <= k)


def best_with_texts(queries: DataFrame, corpus: Corpus, k: int, others: bool = False) -> DataFrame:
    """Asked.best() without vectors: what is alike but for its text is searched by kinds, and texts are compared where they can still decide.

    A text adds to a score and takes nothing off. So the kth score without texts (best_by_kinds) is a threshold, and in the blocks of companies with words
    a query needs a certain similarity to reach it, above what their bounds have without texts. Pairs with that similarity are scored, and the k best of them and of
    those without texts are the k best of all. others: queries are companies themselves (query_id is their key) and don't match themselves.
    """
    key, ahead = corpus.key, k + int(others)
    given = {"coherent": F.lit(True), "corroborated": F.lit(True), "segment_trust": F.lit(1.0)}
    queries = stored(queries.withColumns({c: x for c, x in given.items() if c not in queries.columns}), "asking")
    plain = best_by_kinds(queries, corpus.rows.select(key, F.col("place").alias("_place"), *COMPANY_KIND), ahead, key)
    plain = stored(plain.select("query_id", F.col("_place").alias("place"), key, "score", "rank"), "best-without-texts")
    asked = Asked(queries, corpus)
    terms = asked.terms.join(corpus.numbers.select("term", "id"), "term").groupBy("query_id").agg(F.collect_list(F.struct("id", "wq")).alias("_t"))  # of a query's distinct terms
    terms = stored(terms.select("query_id", F.col("_t.id").alias("ids"), F.col("_t.wq").alias("ws")), "asked-vectors")
    kind = F.struct(*QUERY_KIND, "coherent", "corroborated")
    mine = queries.join(terms, "query_id", "left_semi").select("query_id", kind.alias("asked"), "quality", "stage", "team_size", "segment_trust")
    kinds = stored(mine.groupBy("asked").agg(F.min("query_id").alias("query_id"), *[F.any_value(c).alias(c) for c in ("quality", "stage", "team_size", "segment_trust")]), "asked-kinds")
    worded = corpus.rows.join(corpus.vectors.select("place"), "place", "left_semi").select("place", key, "macros", "c_keys", "c_cause", "cause_inferred", "c_country", "c_year", "c_dead")
    worded = stored(worded, "with-words")
    keys = retrieval.asked_keys(Asked(kinds.select("asked.*", "query_id", "quality", "stage", "team_size", "segment_trust"), corpus, terms=False).rows, worded)
    reach = retrieval.bounds(keys, retrieval.entries(worded), retrieval.blocks(worded, key), texts=True)
    edge = plain.where(F.col("rank") == ahead).select("query_id", F.round("score", 9).alias("_edge"))
    of_kind = mine.join(kinds.select("asked", F.col("query_id").alias("_kind")), "asked").select("query_id", "_kind").join(edge, "query_id", "left")
    need = retrieval.needed(F.coalesce("_edge", F.lit(lx.MIN_SCORE)))
    chosen = of_kind.join(reach.withColumnRenamed("query_id", "_kind"), "_kind").select("query_id", "block", need.alias("need")).where("need <= 1")
    alike = stored(retrieval.similarities(chosen, terms, corpus.vectors), "similarities")
    near = asked.of_pairs(alike, worded).select("query_id", "place", key, "score", "lexical")
    both = plain.select("query_id", "place", key, "score", F.lit(None).cast("double").alias("lexical")).unionByName(near)
    one = both.groupBy("query_id", "place", key).agg(F.max("score").alias("score"), F.max("lexical").alias("lexical"))
    ranked = scoring.ranked(one.where(F.col(key) != F.col("query_id")) if others else one, "query_id", key).where(F.col("rank") <= k)
    found = stored(ranked.select("query_id", "place", "lexical", "rank"), "best")
    return asked.of_pairs(found, corpus.rows)


#: Matches whose order the profile can change.
HEAD = 50


def consult(queries: DataFrame, companies: DataFrame, macros: dict[str, list[str]] | None = None, top: int = 25, models: dict[str, list[str]] | None = None, causes: dict[str, list[str]] | None = None, corpus: Corpus | None = None) -> DataFrame:
    """query_id, company_id, name, outcome, score, final_rank, confidence, reasons of the best matches."""
    corpus = corpus or Corpus(companies)
    # each step reads the stored one before: their plans, joined to themselves, would double with each step
    q = stored(corrected(stored(analyzed(queries, macros), "analyzed"), corpus.idf.select("term", "df")), "corrected")
    cells = segments.cells(corpus.rows.withColumn("outcome", cl.outcome(F.col("status"))))
    q = stored(segment_trust(coherence(q, models, causes), cells), "queries")
    dense = "embedding" in q.columns and "embedding" in corpus.rows.columns
    rows = Asked(q, corpus).best(max(HEAD, top)) if dense else best_with_texts(q, corpus, max(HEAD, top))
    parts = {
        "country": F.when((F.col("q_country_key") != "") & (F.col("c_country") != ""), (F.col("q_country_key") == F.col("c_country")).cast("double")),
        "decade": scoring.nearness(F.col("q_year"), F.col("c_year"), 20.0),
        "headcount": scoring.nearness(cl.headcount_band(F.col("q_team_size")), cl.headcount_band(F.col("headcount")), 5.0),
        "stage": scoring.nearness(cl.stage_ordinal(F.col("q_stage")), cl.implicit_stage(F.col("headcount")), 4.0),
        "model": F.when(F.col("q_model_key") != "", F.array_contains("c_keys", F.col("q_model_key")).cast("double")),
    }
    rows = scoring.rerank(rows.withColumn("similarity", scoring.profile_similarity(parts)), "similarity", head=HEAD)
    level = scoring.confidence(F.col("score"), F.col("dims"), F.col("convergence"), F.col("q_quality.short"), F.col("q_segment_trust"))
    out = rows.where(F.col("final_rank") <= top)
    return out.select("query_id", "company_id", "name", cl.outcome(F.col("status")).alias("outcome"), cl.round4(F.col("final_score")).alias("score"), "final_rank", level.alias("confidence"), scoring.explain(F.col("dims")).alias("reasons"), "convergence")


def consult_in_blocks(queries: DataFrame, companies: DataFrame, macros: dict[str, list[str]] | None = None, top: int = 25, block: int = BLOCK, **tables):
    """consult() for any number of queries: one result for each block of them."""
    n, corpus = max(1, -(-queries.count() // block)), Corpus(companies)
    for k in range(n):
        yield consult(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k), companies, macros, top, corpus=corpus, **tables)


def diagnosis(matches: DataFrame, companies: DataFrame, queries: DataFrame, top: int = 15) -> DataFrame:
    """query_id, direction, gap: outcomes of the closest matches against those of the queries' segments."""
    best = matches.where(F.col("final_rank") <= top).groupBy("query_id").agg(*cohorts.outcome_counts())
    found = segments.outcomes(segments.of_queries(queries, segments.cells(companies.withColumn("outcome", cl.outcome(F.col("status"))))))
    segment = queries.select("query_id", segments.signature(F.col("macros")).alias("asked")).join(found, "asked").drop("asked")
    return cohorts.path_signal(best, segment, ["query_id"])


#: Verdicts by direction; the wording is this package's own.
VERDICTS = {
    "NEGATIVO": "Your closest peers died more often than your segment: %s of them.",
    "POSITIVO": "Your closest peers survived more often than your segment.",
    "NEUTRO": "Your closest peers fared as your segment did.",
    "INCERTO": "There are too few peers to tell.",
}


def verdict(direction: Column, dead_share: Column, short_input: Column) -> Column:
    """A sentence for a direction; a short input overrides it."""
    share = F.format_string("%.0f %%", dead_share * 100)
    text = F.coalesce(*[F.when(direction == d, F.replace(F.lit(t), F.lit("%s"), share)) for d, t in VERDICTS.items()], F.lit(VERDICTS["INCERTO"]))
    return F.when(short_input, "The input is too short for a verdict.").otherwise(text)


def payload(matches: DataFrame) -> DataFrame:
    """query_id, payload: the matches of a query as JSON, in rank order. A query has at most `top` of them."""
    fields = ["final_rank", "name", "outcome", "score", "confidence", "reasons"]
    rows = F.array_sort(F.collect_list(F.struct(*fields)))
    return matches.groupBy("query_id").agg(F.to_json(F.struct(rows.alias("matches"))).alias("payload"))


def report(matches: DataFrame) -> DataFrame:
    """query_id, report: the matches of a query as text."""
    w = Window.partitionBy("query_id").orderBy("final_rank")
    line = F.format_string("%2d. %s [%s] %.1f (%s): %s", "final_rank", "name", "outcome", "score", "confidence", F.array_join("reasons", ", "))
    rows = matches.withColumn("_n", F.row_number().over(w)).withColumn("_line", line)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda r: r["_line"]), "\n").alias("report"))
