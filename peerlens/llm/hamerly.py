"""K-means over whole-number vectors with Hamerly's bounds.

A vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to the second nearest. When centroids
move, the upper bound grows by the drift of the vector's own centroid and the lower one shrinks by the largest drift of the others. While
upper < lower (or upper < half the distance from the own centroid to its nearest neighbour) the assignment can't change and no distance
is computed. Otherwise the upper bound is made exact first, and only what is still ambiguous meets all centroids, in exact integers.

Vectors and bounds lie in the shared folder, one table a round; the table of the round before goes once the next is written, so a lost
executor costs the reading of a split. Sums of clusters are kept as whole numbers and change by the vectors that moved: the first row
of each batch carries its batch's change, so that a round reads the vectors once. What reaches the driver is k * (DIM + 1) sums a round.

Defined results: only vectors of exactly DIM components, none null or non-finite, take part; others have no row. Components become
floor(1024 * x); beyond 2^27 in size they raise an error, since distances would not fit a long. Repeated vec_ids are rows of their own;
a null vec_id takes part but comes last where starts are chosen; equal hashes go by the vector. Fewer than k vectors give as many
centroids. Equal distances go to the smaller number. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import made, release, written

DIM = 64
K = 8
ROUNDS = 10
SCALE = 1024
LIMIT = 2**27
SAFE = 2**20  # components up to this have exact products in doubles
SLACK = 1e-12


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # NaN is above all in Spark's order
    return F.coalesce(fine, F.lit(False))


def scaled(values: np.ndarray, scale: int, limit: int = LIMIT) -> np.ndarray:
    """floor(scale * x) as 32-bit integers."""
    out = np.floor(values.astype(np.float64) * scale)
    if out.size and np.abs(out).max() > limit:
        raise ValueError(f"a component beyond {limit}: results would not fit a long")
    return out.astype("<i4")


def packed(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * 4
    return pa.array([m.tobytes() for m in np.ascontiguousarray(matrix)], pa.binary()) if width else pa.array([b""] * len(matrix), pa.binary())


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim)


def prepared(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors that take part, as packed integers."""
    kept = embeddings.where(usable(F.col("embedding")) & (F.size("embedding") == dim)).select("vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(scaled(values, scale))], names=["vec_id", "v"])

    return kept.mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, v binary")


def starts(vectors: DataFrame, k: int, dim: int, salt: str = "3:") -> np.ndarray:
    """The k vectors whose salted ids have the smallest SHA-256."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    found = vectors.select(mark.alias("mark"), "v").orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in found], np.int64).reshape(len(found), dim)


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids, as 64-bit integers."""
    if v.size and max(np.abs(v).max(), np.abs(centroids).max()) <= SAFE:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    a = v.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in centroids], 1)


def _own(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) - centroids[cluster]) ** 2).sum(1)


def _scanned(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid and both bounds by a full scan."""
    d = _distances(v, centroids)
    cluster = d.argmin(1)
    rows = np.arange(len(d))
    upper = np.sqrt(d[rows, cluster].astype(np.float64)) * (1 + SLACK)
    if len(centroids) == 1:
        return cluster, upper, np.full(len(d), np.inf)
    d[rows, cluster] = np.iinfo(np.int64).max
    return cluster, upper, np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK)


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower after the centroids moved by `drift`, and how many vectors met all centroids."""
    order = np.argsort(-drift)
    farthest = np.full(len(drift), drift[order[0]])
    farthest[order[0]] = drift[order[1]] if len(drift) > 1 else 0.0
    upper = (upper + drift[cluster]) * (1 + SLACK)
    lower = lower - farthest[cluster] * (1 + SLACK) - SLACK
    between = _distances(centroids, centroids).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    bound = np.maximum(lower, (np.sqrt(between.min(1)) / 2 * (1 - SLACK))[cluster])
    open_ = np.flatnonzero(~(upper < bound))
    if len(open_):
        upper[open_] = np.sqrt(_own(v[open_], centroids, cluster[open_]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < bound[open_])]
    if len(open_):
        cluster = cluster.copy()
        cluster[open_], upper[open_], lower[open_] = _scanned(v[open_], centroids)
    return cluster, upper, lower, len(open_)


def _change(v: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> list[int] | None:
    """k * (dim + 1) numbers: what the moved vectors add to the sums and counts of clusters."""
    moved = np.arange(len(after)) if before is None else np.flatnonzero(before != after)
    if not len(moved):
        return None
    rows = np.concatenate([v[moved].astype(np.float64), np.ones((len(moved), 1))], 1)  # sums of one batch are exact in doubles
    share = (after[moved][:, None] == np.arange(k)).astype(np.float64)
    if before is not None:
        share -= before[moved][:, None] == np.arange(k)
    return (share.T @ rows).astype(np.int64).ravel().tolist()


def _assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The next table of vectors: cluster, bounds, and the change of each batch in its first row."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unpacked(batch.column("v"), dim)
            if drift is None:
                before, (cluster, upper, lower) = None, _scanned(v, centroids)
            else:
                before = batch.column("cluster").to_numpy(zero_copy_only=False)
                bounds = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("upper", "lower"))
                cluster, upper, lower, _ = reassigned(v, before, *bounds, centroids, drift)
            change = pa.array([_change(v, before, cluster, k)] + [None] * (len(v) - 1), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), change], names=["vec_id", "v", "cluster", "upper", "lower", "change"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id {kind}, v binary, cluster int, upper double, lower double, change array<bigint>")


def _measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            found = _own(unpacked(batch.column("v"), centroids.shape[1]), centroids, cluster)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(found)], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance of every vector after `rounds` of assignment and replacement and one last assignment; the centroids."""
    spark, since = embeddings.sparkSession, made()
    state = written(prepared(embeddings, dim, scale), "hamerly-vectors")
    centroids = starts(state, k, dim)
    if not len(centroids):
        return state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    sums = np.zeros((len(centroids), dim + 1), object)  # whole numbers of any size
    drift = None
    for r in range(rounds + 1):
        state = written(_assigned(state, centroids, drift), "hamerly-state")
        release(spark, state, since)
        if r == rounds:
            break
        parts = state.where(F.col("change").isNotNull()).select(F.posexplode("change").alias("i", "x"))
        change = parts.groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * (dim + 1) rows at most
        for row in change:
            sums[divmod(row["i"], dim + 1)] += int(row["x"])
        after = np.array([[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else list(c) for row, c in zip(sums, centroids)], np.int64)
        if not change and (after == centroids).all():
            break  # further rounds change nothing
        drift = np.sqrt(((after - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        centroids = after
    out = written(_measured(state, centroids), "hamerly-clusters")
    release(spark, out, since)
    return out, centroids.tolist()


def digest(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; one number for each centroid goes by the driver."""
    totals = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values or [None]]), F.col("cluster") + 1)
    inertia = [totals.get(i, 0) for i in range(len(centroids))]
    return found.select("vec_id", "cluster", "distance", pick(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), pick(marks, "string").alias("centroid_sha256"))
