"""Exact best matches of queries by upper bounds of blocks of companies.

Companies lie in blocks of at most BLOCK rows, in the order of macros, categories, outcome, country, year and cause, so that those of a
block have much in common. An inverted file tells for each block and each macro, category, cause, country, year and term the most that it can
add to a score within the block. Queries meet it by equal keys; what they collect in a block is an upper bound of every score
in it. The blocks with the highest bounds are scored first. The kth score found is a threshold: of the other blocks, only those are scored
that can still reach it (or tie with it, by a smaller key). So the result is exact, and what is joined are pairs of queries and blocks,
not of queries and companies.

Texts can instead be left open in the bounds (with_texts()): then no term meets a block, and the pairs of a query and a company with words that can
still come among the best are multiplied out, as sparse vectors, where their block lies.

Vectors are optional: a block keeps its centroid and radius, and a product with a query is at most centroid . query + radius * |query|;
then the stated queries meet the centroids of all blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.functions import text as tx
from peerlens.sources.sinks import stored

from . import containment, scoring, textindex, vectors

BITS = 8
BLOCK = 1 << BITS
#: Blocks of each query that are scored before there is a threshold.
FIRST = 4
#: More than what sums of a few doubles can differ by, and half of the last decimal that ranks look at.
SLACK, HALF = 1e-11, 0.5e-9
W = lx.WEIGHTS


def block_of(place: str = "place") -> Column:
    return F.shiftright(F.col(place), BITS)


def laid(companies: DataFrame, key: str = "company_id", text: str | None = None) -> DataFrame:
    """Companies with the columns that scores need, and `place`: rows in the order of their segments, those without text apart, BLOCK places a block, none over two partitions."""
    rows = companies.withColumns(
        {
            "c_keys": F.filter(F.array_distinct(F.transform(F.coalesce("categories", F.array().cast("array<string>")), tx.compact_key)), lambda c: c != ""),
            "c_country": tx.country_key(F.col("country"), lx.COUNTRY_ALIASES),
            "c_year": cl.leading_year(F.col("founded_year").cast("string")),
            "c_cause": tx.compact_key(F.col("cause")),
            "c_dead": cl.is_dead(F.col("status")),
            "macros": F.array_distinct(F.coalesce("macros", F.array().cast("array<string>"))),
        }
    )
    blank = [tx.absent(F.col(text)).isNull()] if text else []
    order = [*blank, F.concat_ws("|", F.array_sort("macros")), F.concat_ws("|", F.array_sort("c_keys")), "c_dead", "c_country", "c_year", "c_cause", key]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "laid")


def blocks(companies: DataFrame, key: str = "company_id") -> DataFrame:
    """block, size, dead (any), least (smallest key)."""
    return companies.groupBy(block_of().alias("block")).agg(F.count("*").alias("size"), F.max("c_dead").alias("dead"), F.min(key).alias("least"))


def entries(companies: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """block, kind, key, most: the inverted file over blocks; postings: place, term, w."""
    def each(kind: str, keys: Column, most: Column = F.lit(1.0)) -> Column:  # noqa: B008
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), most.alias("most")))

    cause = F.when(F.coalesce("cause_inferred", F.lit(False)), W["cause_inferred"]).otherwise(W["cause"])
    one = lambda c: F.array_compact(F.array(F.nullif(c, F.lit(""))))
    listed = F.concat(each("macro", F.col("macros")), each("category", F.col("c_keys")), each("cause", one(F.col("c_cause")), cause), each("country", one(F.col("c_country"))), each("year", one(F.col("c_year").cast("string"))))
    rows = companies.select(block_of().alias("block"), F.explode(listed).alias("e")).select("block", "e.*")
    if postings is not None:
        rows = rows.unionByName(postings.select(block_of().alias("block"), F.lit("term").alias("kind"), F.col("term").alias("key"), F.col("w").alias("most")))
    return rows.groupBy("block", "kind", "key").agg(F.max("most").alias("most"))


def asked_keys(queries: DataFrame, companies: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """query_id, kind, key, dim, value, points: what a query looks for; terms: query_id, term, wq.

    Queries have the columns that plans.consult gives them: q_macros, q_category_keys, q_model_key, q_coherent, q_country_key, q_year, q_cause_key, q_corroborated, q_secondary_keys.
    """
    def each(kind: str, dim: str, keys: Column, value: Column, points: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.lit(dim).alias("dim"), value.cast("double").alias("value"), points.cast("double").alias("points")))

    share = lambda c: F.try_divide(F.lit(1.0), F.size(c))
    one = lambda c: F.array_compact(F.array(F.nullif(c, F.lit(""))))
    gaps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(1 - (abs(d) / 4) ** 1.5).alias("v")) for d in range(-3, 4)])
    years = F.transform(gaps, lambda g: F.struct(F.lit("year").alias("kind"), (F.col("q_year") + g["d"]).cast("string").alias("key"), F.lit("era").alias("dim"), g["v"].alias("value"), (g["v"] * W["era"]).alias("points")))
    listed = F.concat(
        each("macro", "macro", F.array_distinct("q_macros"), share("q_macros"), share("q_macros") * W["macro"]),
        each("category", "category", F.array_distinct("q_category_keys"), share("q_category_keys"), share("q_category_keys") * W["category"]),
        F.when(F.col("q_coherent"), each("category", "model", one(F.col("q_model_key")), F.lit(1.0), F.lit(W["model"]))).otherwise(F.array().cast("array<struct<kind:string,key:string,dim:string,value:double,points:double>>")),
        each("cause", "cause", one(F.col("q_cause_key")), F.lit(1.0), F.when(F.col("q_corroborated"), 1.0).otherwise(0.6)),
        each("cause", "secondary", F.col("q_secondary_keys"), F.lit(1.0), F.lit(W["secondary"])),
        F.when(F.col("q_year").isNotNull(), years).otherwise(F.array().cast("array<struct<kind:string,key:string,dim:string,value:double,points:double>>")),
    )
    rows = queries.select("query_id", F.explode(listed).alias("e")).select("query_id", "e.*")
    met = containment.within_each_other(queries, "q_country_key", companies, "c_country")
    near = queries.select("query_id", "q_country_key").join(met, "q_country_key")
    rows = rows.unionByName(near.select("query_id", F.lit("country").alias("kind"), F.col("c_country").alias("key"), F.lit("country").alias("dim"), F.lit(1.0).alias("value"), F.lit(W["country"]).alias("points")))
    if terms is not None:
        rows = rows.unionByName(terms.select("query_id", F.lit("term").alias("kind"), F.col("term").alias("key"), F.lit("lexical").alias("dim"), F.col("wq").alias("value"), F.lit(W["lexical"]).alias("points")))
    return rows


def bounds(asked: DataFrame, file: DataFrame, block_table: DataFrame, dense: DataFrame | None = None, least: float = lx.MIN_SCORE, texts: bool = False) -> DataFrame:
    """query_id, block, size, least, bound: blocks that can hold a score of `least`; dense: query_id, block, value (at most), points.

    texts: asked and file have no terms, and any lexical similarity is possible; then bound is without it, and `open` tells where a strong one brings the bonus.
    """
    met = asked.join(file, ["kind", "key"])
    of = lambda dim, x: F.when(F.col("dim") == dim, x)
    value, points, most = F.col("value"), F.col("points"), F.col("most")
    sums = met.groupBy("query_id", "block").agg(
        *[F.coalesce(F.sum(of(d, value)), F.lit(0.0)).alias(d) for d in ("macro", "category")],
        F.coalesce(F.sum(of("lexical", value * most)), F.lit(0.0)).alias("lexical"),
        *[F.max(of(d, value)).alias(f"{d}_v") for d in ("model", "cause", "secondary", "country", "era")],
        *[F.coalesce(F.max(of(d, points)), F.lit(0.0)).alias(d) for d in ("model", "secondary", "country", "era")],
        F.coalesce(F.max(of("cause", points * most)), F.lit(0.0)).alias("cause"),
    )
    if dense is not None:
        sums = sums.join(dense.withColumnsRenamed({"value": "semantic_v", "points": "semantic"}), ["query_id", "block"], "full_outer").fillna(0.0)
    strong = [F.col(d) >= 0.3 - SLACK for d in ("macro", "category", "lexical")] + [F.coalesce(F.col(f"{d}_v"), F.lit(0.0)) >= 0.3 for d in ("model", "cause", "secondary", "country", "era")]
    if dense is not None:
        strong.append(F.coalesce("semantic_v", F.lit(0.0)) >= 0.3 - SLACK)
    strongs = sum((s.cast("int") for s in strong), F.lit(0))
    many = strongs >= 4
    total = F.least("macro", F.lit(1.0)) * W["macro"] + F.least("category", F.lit(1.0)) * W["category"]
    total = total + F.when(F.col("lexical") >= lx.MIN_LEXICAL - SLACK, F.least("lexical", F.lit(1.0)) * W["lexical"]).otherwise(0.0)
    for d in ("model", "cause", "secondary", "country", "era", *(["semantic"] if dense is not None else [])):
        total = total + F.col(d)
    rows = sums.join(block_table, "block")
    bound = total + F.when(F.col("dead") & many, lx.CONVERGENCE_BONUS).otherwise(0.0) + SLACK
    found = rows.select("query_id", "block", "size", "least", bound.alias("bound"), *([(F.col("dead") & (strongs == 3)).alias("open")] if texts else []))
    reach = F.col("bound") + W["lexical"] + F.when(F.col("open"), lx.CONVERGENCE_BONUS).otherwise(0.0) if texts else F.col("bound")
    return found.where(reach >= least - HALF)


def dense_bounds(queries: DataFrame, companies: DataFrame, trust: Column, block: int) -> DataFrame:
    """query_id, block, value, points: the most that the semantic dimension can give in each block."""
    rows = companies.where(F.col("embedding").isNotNull()).withColumn("block", block_of())
    cents = vectors.centroids(rows, "block").withColumnRenamed("cluster_id", "block")
    radius = rows.join(cents, "block").groupBy("block").agg(F.max(F.sqrt(vectors.squared_distance(F.col("embedding"), F.col("centroid")))).alias("radius"))
    asked = queries.where(F.col("q_embedding").isNotNull()).select("query_id", "q_embedding", trust.alias("_trust"))
    pairs = vectors.against_all(cents.join(radius, "block"), asked, "query_id", F.lit(True), block)
    reach = vectors.dot(F.col("q_embedding"), F.col("centroid")) + F.col("radius") * F.sqrt(vectors.dot(F.col("q_embedding"), F.col("q_embedding"))) + 1e-9
    value = scoring.semantic_value(reach)
    return pairs.where(reach >= lx.MIN_SEMANTIC).select("query_id", "block", value.alias("value"), (value * W["semantic"] * F.col("_trust")).alias("points"))


def needed(edge: Column) -> Column:
    """The least lexical similarity with which a row of a block of bounds(texts=True) can reach a score of `edge`; above 1 if none can."""
    gap = edge - 2 * HALF - F.col("bound")
    bonus = F.when(F.col("open"), F.greatest(F.lit(0.3), (gap - lx.CONVERGENCE_BONUS) / W["lexical"]))
    return F.greatest(F.lit(lx.MIN_LEXICAL), F.least(gap / W["lexical"], bonus)) - SLACK  # least() leaves out null


#: Blocks, as a power of two, whose vectors come to one group of a task.
TOGETHER = 3


def similarities(chosen: DataFrame, asked: DataFrame, companies: DataFrame) -> DataFrame:
    """query_id, place, lexical: pairs of a query and a row of the chosen blocks with at least the similarity that is needed.

    chosen: query_id, block, need; asked: query_id, ids, ws; companies: place, ids, ws; ids are numbers of terms, ws their weights. A group holds 2,048 companies.
    """
    kind = chosen.schema["query_id"].dataType.simpleString()
    part = F.shiftright("block", TOGETHER).alias("part")
    left = chosen.groupBy("query_id", part).agg(F.collect_list(F.struct("block", "need")).alias("blocks")).join(asked, "query_id").select("part", "query_id", "blocks", "ids", "ws")
    right = companies.withColumn("block", block_of()).select(part, "block", "place", "ids", "ws")

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        asking, by, found, dots = queries["query_id"], [], [], []
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by("place").combine_chunks()
            place, listed = rows["place"].to_numpy(), rows["ids"].combine_chunks()
            terms, at = np.unique(listed.flatten().to_numpy(), return_inverse=True)
            weights, offsets = rows["ws"].combine_chunks().flatten().to_numpy(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
            names, begins = np.unique(rows["block"].to_numpy(), return_index=True)
            spans = dict(zip(names.tolist(), zip(begins, [*begins[1:], len(place)])))
            for n, (blocks, ids, ws) in enumerate(zip(queries["blocks"], queries["ids"], queries["ws"])):
                ids, ws = ids.values.to_numpy(), ws.values.to_numpy()
                k = np.minimum(np.searchsorted(terms, ids), len(terms) - 1)
                q = np.zeros(len(terms))
                met = terms[k] == ids
                q[k[met]] = ws[met]
                for b in blocks.as_py():
                    if b["block"] in spans:
                        i, j = spans[b["block"]]
                        lo, hi = offsets[i], offsets[j]
                        sums = np.add.reduceat(q[at[lo:hi]] * weights[lo:hi], offsets[i:j] - lo)
                        hit = np.flatnonzero(sums >= b["need"])
                        by.append(np.full(len(hit), n))
                        found.append(place[i + hit])
                        dots.append(sums[hit])
        joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"query_id": asking.take(pa.array(joined(by, np.int64))), "place": joined(found, np.int64), "lexical": joined(dots, np.float64)})

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, f"query_id {kind}, place bigint, lexical double")


Score = Callable[[DataFrame], DataFrame]


def best(candidates: DataFrame, score: Score, k: int, key: str = "company_id", least: float = lx.MIN_SCORE) -> DataFrame:
    """The k best rows of each query with their rank, exactly. candidates: the rows of bounds(); score: (query_id, block) -> scored rows of these blocks.

    Ranks are by score to nine decimals, then by the smaller key.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    ranked = stored(candidates.withColumn("nth", F.row_number().over(order)), "bounds")

    def first(rows: DataFrame) -> DataFrame:
        return scoring.ranked(rows, "query_id", key, least).where(F.col("rank") <= k)

    probed = stored(first(score(ranked.where(F.col("nth") <= FIRST).select("query_id", "block"))), "probed")
    edge = probed.where(F.col("rank") == k).select("query_id", F.round("score", 9).alias("_edge"), F.col(key).alias("_last"))
    above, ties = F.col("bound") >= F.col("_edge") + HALF, F.col("bound") >= F.col("_edge") - HALF
    rest = ranked.where(F.col("nth") > FIRST).join(edge, "query_id", "left").where(F.col("_edge").isNull() | above | (ties & (F.col("least") < F.col("_last"))))
    later = first(score(rest.select("query_id", "block")))
    return first(probed.drop("rank").unionByName(later.drop("rank")))


def work(candidates: DataFrame, result: DataFrame, k: int, block_table: DataFrame, queries: DataFrame, key: str = "company_id") -> DataFrame:
    """One row: pairs of queries and companies there are, pairs in blocks that can reach the least score, and pairs that best() scores at most."""
    sizes = block_table.agg(F.sum("size").alias("n")).crossJoin(queries.agg(F.count("*").alias("q"))).select((F.col("n") * F.col("q")).alias("pairs"))  # one row each
    edge = result.where(F.col("rank") == k).select("query_id", F.round("score", 9).alias("_edge"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    rows = candidates.withColumn("nth", F.row_number().over(order)).join(edge, "query_id", "left")
    met = rows.agg(F.sum("size").alias("reachable"), F.sum(F.when((F.col("nth") <= FIRST) | F.col("_edge").isNull() | (F.col("bound") >= F.col("_edge") - HALF), F.col("size"))).alias("scored"))
    return met.crossJoin(sizes)
