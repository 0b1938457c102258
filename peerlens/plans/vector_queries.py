"""Queries over vectors: top-k, centroids, inverted file, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.functions import classify as cl
from peerlens.functions import lexicons as lx
from peerlens.operators import cohorts, scoring, vectors

from .analogs import round4
from .registry import load, query

ASKED = "vec_id % 100 = 0"  # the stated queries, against all rows

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"

_PAIRS = f"""q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE {ASKED}),
s AS (SELECT query_id, vec_id, {DOT.format(a="qv", b="embedding")} AS score FROM q JOIN embeddings ON vec_id <> query_id)"""

CENTS = """cent AS (SELECT cluster_id, list(m ORDER BY i) AS centroid FROM (SELECT label AS cluster_id, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY label, i) GROUP BY cluster_id)"""
NEAR = f"""near AS (SELECT vec_id, arg_min(cluster_id, (round(d, 9), cluster_id)) AS cluster_id, sqrt(min(round(d, 9))) AS distance FROM (SELECT vec_id, cluster_id, {DIST.format(a="embedding", b="centroid")} AS d FROM embeddings, cent) GROUP BY vec_id)"""


def _asked(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return e.where(ASKED).select(F.col("vec_id").alias("query_id"), "embedding"), e


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, {round4('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def vector_topk(spark, sf_dir):
    q, e = _asked(spark, sf_dir)
    return vectors.topk(q, "query_id", e, "vec_id").withColumn("score", cl.round4(F.col("score")))


@query(f"WITH {CENTS}, {NEAR} SELECT vec_id, cluster_id, {round4('distance')} AS distance FROM near")
def nearest_centroid(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return vectors.nearest_centroid(e, vectors.centroids(e, "label"), "vec_id").withColumn("distance", cl.round4(F.col("distance")))


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, {round4('24.0 * least(1.0, greatest(0.0, (score - 0.22) / 0.48))')} AS points FROM s WHERE score >= 0.22")
def semantic_rescale(spark, sf_dir):
    q, e = _asked(spark, sf_dir)
    pairs = vectors.above(q, "query_id", e, "vec_id", lx.MIN_SEMANTIC)
    points = scoring.semantic(F.col("score"))["points"]
    return pairs.select("query_id", "vec_id", cl.round4(points).alias("points"))


@query(f"WITH {CENTS}, {NEAR} SELECT label, vec_id, {round4('distance')} AS distance, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) AS rank FROM near JOIN embeddings USING (vec_id) QUALIFY rank <= 3")
def cluster_examples(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    near = vectors.nearest_centroid(e, vectors.centroids(e, "label"), "vec_id").join(e.select("vec_id", "label"), "vec_id")
    return vectors.nearest_examples(near, ["label"], "vec_id").select("label", "vec_id", cl.round4(F.col("distance")).alias("distance"), "rank")


@query(f"""WITH {CENTS}, {NEAR}, {_PAIRS},
probe AS (SELECT query_id, cluster_id FROM (SELECT query_id, cluster_id, row_number() OVER (PARTITION BY query_id ORDER BY round({DIST.format(a="qv", b="centroid")}, 9), cluster_id) AS n FROM q, cent) WHERE n <= 8)
SELECT query_id, vec_id, {round4('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s JOIN near USING (vec_id) JOIN probe USING (query_id, cluster_id) QUALIFY rank <= 10""")
def ivf_topk(spark, sf_dir):
    q, e = _asked(spark, sf_dir)
    return vectors.ivf_topk(q, "query_id", e, "vec_id", vectors.centroids(e, "label")).withColumn("score", cl.round4(F.col("score")))


@query()
def kmeans_profile(spark, sf_dir):
    """Sizes and outcomes of clusters; ids depend on the library, so there is no SQL."""
    e = load(spark, sf_dir, "embeddings")
    placed = vectors.with_cluster(e, vectors.kmeans(e))
    rows = placed.withColumn("outcome", F.when(F.col("label") % 3 == 0, "dead").when(F.col("label") % 3 == 1, "operating").otherwise("acquired"))
    return rows.groupBy("cluster_id").agg(*cohorts.outcome_counts())
