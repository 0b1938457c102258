"""TF-IDF postings and cosine retrieval through an inverted-index join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.functions import text as tx
from peerlens.sources.sinks import stored

BROADCAST_TERMS = 500_000  # rows of a table of terms that is broadcast at most
BLOCK = 1_000  # items that meet all documents at once where no term narrows them

def counted(words: Column) -> Column:
    """Array of struct<term, n> of an array of words: the beginnings of runs in the sorted array, so nothing is shuffled."""
    def runs(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return cl.once(at, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("n"))))

    return F.when(F.size(words) > 0, cl.once(F.sort_array(words), runs))


def repeated(docs: DataFrame, key: str) -> bool:
    """Whether rows share a key."""
    return not docs.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def term_counts(docs: DataFrame, key: str, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """key, term, n, total: occurrences of each term of a document and its number of tokens. Rows are counted where they lie unless some share a key."""
    words = docs.select(key, tx.tokens(F.col(text), stopwords).alias("_w"))
    if repeated(docs, key):
        return words.select(key, F.size("_w").alias("total"), F.explode("_w").alias("term")).groupBy(key, "total", "term").agg(F.count("*").alias("n"))
    return words.select(key, F.size("_w").alias("total"), F.explode(counted(F.col("_w"))).alias("_t")).select(key, "total", "_t.*")


def idf_table(counts: DataFrame, documents: int) -> DataFrame:
    """term, df, idf = ln((1 + N) / (1 + df)) + 1; N counts all documents, empty ones too."""
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(1.0) + documents) / (F.col("df") + 1.0)) + 1.0)


def carried(terms: DataFrame) -> DataFrame:
    """Terms as a broadcast side if they are few."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def _raw(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    return counts.join(carried(idf.select("term", "idf")), "term").select(key, "term", (F.col("n") / F.col("total") * F.col("idf")).alias("raw"))


def weighted(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """key, term, w: tf * idf with unit length for each document; terms without idf drop out. One shuffle by document."""
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return _raw(counts, idf, key).select(key, "term", (F.col("raw") / norm).alias("w"))


def vectors(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """key, ids, ws: weighted() as one row for each document; idf: term, idf, and id, the term's number."""
    raw = counts.join(carried(idf.select("term", "idf", "id")), "term").select(key, "id", (F.col("n") / F.col("total") * F.col("idf")).alias("raw"))
    rows = raw.groupBy(key).agg(F.collect_list(F.struct("id", "raw")).alias("_t"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"))  # of a document's distinct terms
    return rows.select(key, F.col("_t.id").alias("ids"), F.transform("_t.raw", lambda x: x / F.col("_norm")).alias("ws"))


def index(docs: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Term counts and idf of documents, written once: every later step reads them and not the texts."""
    counts = stored(term_counts(docs, key, text), "term-counts")
    return counts, stored(idf_table(counts, docs.count()), "idf")


def cosine_topk(queries: DataFrame, query_key: str, docs: DataFrame, doc_key: str, text: str = "text", k: int = 10, least: float = 0.08, indexed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_key, doc_key, score, rank: the k documents closest to each query.

    Only postings of terms that some query has are joined; no pair of a query and a document without a
    common term ever arises. Ties go to the smaller document key.
    """
    counts, idf = indexed or index(docs, doc_key, text)
    asked = stored(weighted(term_counts(queries, query_key, text), idf, query_key).withColumnRenamed("w", "wq"), "asked")
    raw = _raw(counts, idf, doc_key)
    norms = raw.groupBy(doc_key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    met = raw.join(carried(asked.select("term").distinct()), "term", "left_semi").join(norms, doc_key).select(doc_key, "term", (F.col("raw") / F.col("norm")).alias("w"))
    scored = met.join(carried(asked), "term").groupBy(query_key, doc_key).agg(F.sum(F.col("wq") * F.col("w")).alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), doc_key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shared_terms(pairs: DataFrame, asked: DataFrame, postings: DataFrame, query_key: str, doc_key: str, k: int = 5) -> DataFrame:
    """query_key, doc_key, terms: for given pairs the k terms that add most to their cosine, ties by the later word; a pair has no more than the query's terms."""
    met = pairs.select(query_key, doc_key).join(asked, query_key).join(postings, [doc_key, "term"])
    rows = met.select(query_key, doc_key, F.struct(F.round(F.col("wq") * F.col("w"), 9).alias("p"), "term").alias("t"))
    return rows.groupBy(query_key, doc_key).agg(F.transform(F.slice(F.sort_array(F.collect_list("t"), False), 1, k), lambda t: t["term"]).alias("terms"))


def containing(items: DataFrame, item_key: str, docs: DataFrame, doc_key: str, counts: DataFrame, idf: DataFrame, text: str = "text") -> DataFrame:
    """item_key, doc_key of documents that hold an item's text.

    An item meets the documents that have its rarest inner word (the words at its ends may be parts of longer ones),
    and those are confirmed. Items without such a word meet all documents, in blocks.
    """
    inner = F.slice(tx.tokens(F.col(text), []), 2, F.greatest(F.size(tx.tokens(F.col(text), [])) - 2, F.lit(0)))
    rows = items.select(item_key, F.col(text).alias("_item"), F.filter(inner, lambda w: ~w.isin(lx.STOPWORDS)).alias("_words"))
    told = rows.select(item_key, "_item", F.explode("_words").alias("term")).join(carried(idf.select("term", "df")), "term", "left")
    # a word that no document has means that none holds the item
    rarest = told.groupBy(item_key, "_item").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"))
    near = stored(counts.select(doc_key, "term").join(carried(rarest), "term").select(item_key, "_item", doc_key), "near")
    # few candidates go to the texts, so that those are not shuffled
    found = docs.select(doc_key, F.col(text).alias("_doc")).join(carried(near), doc_key).where(F.contains("_doc", "_item")).select(item_key, doc_key)
    rest = rows.where(F.size("_words") == 0).select(item_key, "_item")
    n = -(-rest.count() // BLOCK)
    for i in range(n):
        part = rest.where(F.pmod(F.xxhash64(item_key), F.lit(n)) == i)
        found = found.unionByName(docs.join(F.broadcast(part), F.contains(F.col(text), F.col("_item"))).select(item_key, doc_key))
    return found


def contrastive_terms(postings: DataFrame, key: str, groups: DataFrame, n: int = 10, shortest: int = 3) -> DataFrame:
    """Terms whose mean weight among positive documents most exceeds that among negative ones.

    groups: key, positive (boolean). A term needs max(3, size / 12) positive documents.
    """
    sizes = groups.agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nn"))
    sums = postings.join(groups, key).groupBy("term").agg(
        F.sum(F.when(F.col("positive"), F.col("w")).otherwise(0.0)).alias("sp"),
        F.sum(F.when(~F.col("positive"), F.col("w")).otherwise(0.0)).alias("sn"),
        F.count_if("positive").alias("support"),
    )
    scored = sums.join(F.broadcast(sizes)).where((F.col("support") >= F.greatest(F.lit(3), F.floor(F.col("np") / 12))) & (F.length("term") >= shortest))
    delta = F.try_divide("sp", "np") - F.coalesce(F.try_divide("sn", "nn"), F.lit(0.0))
    return scored.withColumn("delta", delta).where("delta > 0").orderBy(F.desc(F.round("delta", 9)), "term").limit(n).select("term", "support", "delta")


def neighbourhood(word: Column) -> Column:
    """The word and what is left of it without one letter: words within one edit or swap of neighbours have one of these in common."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def fuzzy_corrections(words: DataFrame, vocabulary: DataFrame, shortest: int = 5) -> DataFrame:
    """word, correction: the vocabulary word within one edit that begins with the same letter; most frequent first, then alphabetical.

    words(word) are those missing from vocabulary(term, df). Both sides are spread to their neighbourhoods of one deletion, which
    meet in an equi-join; no key is hotter than the words that are alike. What meets is confirmed.
    """
    missing = words.select("word").distinct().where(F.length("word") >= shortest).join(vocabulary, F.col("word") == F.col("term"), "left_anti")
    asked = missing.select("word", F.explode(neighbourhood(F.col("word"))).alias("_near"))
    known = vocabulary.where(F.length("term") >= 4).select("term", "df", F.explode(neighbourhood(F.col("term"))).alias("_near"))
    near = asked.join(known, "_near").where((F.left("word", F.lit(1)) == F.left("term", F.lit(1))) & tx.within_one_edit(F.col("word"), F.col("term")))
    return near.groupBy("word").agg(F.min_by("term", F.struct(-F.col("df"), F.col("term"))).alias("correction"))
