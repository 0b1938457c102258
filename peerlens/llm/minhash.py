"""Near-duplicates by min-max hashing with exact confirmation.

1. One pass over the texts gives each row its set's size, a 128-bit key of the set and BANDS band keys. A
   permutation gives both its minimum and its maximum, so PERMUTATIONS hash evaluations make twice as many
   signature values; a band is the two minima and maxima of two permutations. A pair at similarity 0.75 shares no
   band with a probability of about (1 - 0.75**4)**32 = 5e-6.
2. Rows of one set (copies) are one class; its least doc_id stands for it from here on.
3. Documents that share buckets of bands, directly or through others, form a candidate cluster: each member is
   tied to its bucket's least member only, so the ties are as many as the members and never the pairs.
4. Each member first meets one other, the least member of a bucket that it shares most bands with: by this most
   groups are joined, in work that grows with the members.
5. Where a cluster still has several components, members of different ones must meet too. It is cut into blocks of
   bounded size, and each two blocks meet in one tile, but for those of one and the same component. A tile compares the full
   sets of its members, all at once by a product of incidence matrices, and returns the links that join its
   components, at most one for each member. Links within a cluster are all found, whether or not a band was shared.
6. Components of the links are the groups.

Defined results: a text without words (null, empty) has an empty set and is linked with nothing; a row without doc_id
is linked with nothing either, has no component and is not kept; repeated rows are copies; rows of one doc_id are
one document, which is linked by any of its texts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, written
from .components import HOT, components, looked_up
from .shingles import SIZE, mix, shingle_set

PERMUTATIONS = 64
BANDS = 32
THRESHOLD = 75  # percent
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 1_500_000
COLUMNS = 2048
_rng = np.random.default_rng(20_240_501)
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the hashes under each permutation."""
    least, most = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096][None, :] * _A[:, None] + _B[:, None]
        np.minimum(least, h.min(1), out=least)
        np.maximum(most, h.max(1), out=most)
    return least, most


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least, most = signature(hashes)
    per = PERMUTATIONS // BANDS
    keys = np.arange(BANDS, dtype=np.uint64)
    for x in (least, most):
        for j in range(per):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + x.reshape(BANDS, per)[:, j])
    return keys


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    return np.array([mix(hashes).sum(dtype=np.uint64), mix(hashes + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)], np.uint64).tobytes()


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                n, keys, bands = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, size)
                    n.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    bands.append(band_keys(s).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, as a matrix."""
    out = np.zeros((len(left), len(right)))
    if len(left) * len(right) <= 16:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    values_l, values_r = np.concatenate(left), np.concatenate(right)
    rows_l, rows_r = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(values_l, values_r)
    at_l, at_r = np.searchsorted(shared, values_l), np.searchsorted(shared, values_r)
    for at, values, rows in ((at_l, values_l, rows_l), (at_r, values_r, rows_r)):
        at[at == len(shared)] = 0
        at[shared[at] != values if len(shared) else slice(None)] = -1
    order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
    at_l, rows_l, at_r, rows_r = at_l[order_l], rows_l[order_l], at_r[order_r], rows_r[order_r]
    for begin in range(0, len(shared), COLUMNS):  # a few columns at a time keep the memory bounded
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        for m, at, rows in ((x, at_l, rows_l), (y, at_r, rows_r)):
            s = slice(*np.searchsorted(at, [begin, begin + COLUMNS]))
            m[rows[s], at[s] - begin] = 1
        out += x @ y.T
    return out


def tile_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], threshold: int) -> list[tuple[int, int]]:
    """Links between two blocks (or within one, if `right` is empty) that suffice to join what is linked."""
    other = right or left
    if not left or not other:
        return []
    both = _common([s for _, s in left], [s for _, s in other])
    sizes_l, sizes_r = np.array([len(s) for _, s in left]), np.array([len(s) for _, s in other])
    linked = (both > 0) & (100 * both.astype(np.int64) >= threshold * (sizes_l[:, None] + sizes_r[None, :] - both.astype(np.int64)))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = left[i][0], other[j][0]
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def confirmed(dealt: DataFrame, stored: DataFrame, threshold: int, size: int) -> DataFrame:
    """Links (a, b) found in tiles; dealt: doc_id, cluster, block, low, high. A tile (cluster, low, high) compares the block
    `low` with the block `high`, or a block with itself. stored is bucketed by doc_id."""
    # the few members are shuffled to the texts and not the texts to them
    rows = stored.join(dealt.hint("shuffle_hash"), "doc_id").repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, left, right = None, [], []

        def links():
            found = tile_links(left, right, threshold)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("cluster", "low", "high", "block", "doc_id", "text"))
            for cluster, low, high, block, doc, text in zip(*columns, strict=True):
                if (cluster, low, high) != tile:
                    if tile is not None and (tile[1] == tile[2] or right):
                        yield links()
                    tile, left, right = (cluster, low, high), [], []
                (left if block == low else right).append((doc, shingle_set(text, size)))
        if tile is not None and (tile[1] == tile[2] or right):
            yield links()

    return rows.mapInArrow(run, "a long, b long")


def stars(ties: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tiles of each member with its nearest: the bucket's least member that it shares most bands with, the least of several.

    ties: a, b, n (shared bands); sizes: doc_id, n_shingles. A nearest with many members stands in as many tiles as they fill blocks.
    """
    nearest = ties.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("most")).select(F.col("a").alias("doc_id"), (-F.col("most.b")).alias("cluster"))
    nearest = written(nearest.join(sizes, "doc_id"), "nearest")
    load = written(nearest.groupBy("cluster").agg(_blocks().alias("blocks"), F.count("*").alias("n")), "load")
    members = looked_up(nearest, "cluster", load.select("cluster", "blocks"), hot=load.where(F.col("n") > HOT).select("cluster")).select("doc_id", "cluster", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("high"))
    members = members.select("doc_id", "cluster", F.col("high").alias("block"), (-1 - F.col("high")).alias("low"), "high")
    centres = load.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("high"))
    return members.unionByName(centres.select(F.col("cluster").alias("doc_id"), "cluster", (-1 - F.col("high")).alias("block"), (-1 - F.col("high")).alias("low"), "high"))


def tiles(members: DataFrame) -> DataFrame:
    """Tiles of members (doc_id, cluster, component, n_shingles) that are in one cluster and may be in different components.

    A component that fills more than a block has blocks of its own, which don't meet each other; the small ones
    of a cluster share blocks.
    """
    parts = members.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), _blocks().alias("blocks"))
    small = F.col("blocks") == 1
    shape = parts.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum(F.when(small, F.col("n"))) / BLOCK_DOCS), F.ceil(F.sum(F.when(small, F.col("s"))) / BLOCK_SHINGLES), F.lit(0)).cast("int").alias("pool"),
        F.coalesce(F.sum(F.when(~small, F.col("blocks"))), F.lit(0)).cast("int").alias("more"),
    )
    # at most one row for each block of members
    before = Window.partitionBy("cluster").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = parts.where(~small).select("cluster", "component", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int").alias("from"))
    placed = members.join(shape, "cluster").join(large, ["cluster", "component"], "left")
    first = F.col("pool") + F.col("from")
    hashed = F.xxhash64("doc_id")
    block = F.when(F.col("from").isNull(), F.pmod(hashed, F.greatest("pool", F.lit(1)))).otherwise(first + F.pmod(hashed, F.col("blocks"))).cast("int")
    met = F.filter(F.sequence(F.lit(0), F.col("pool") + F.col("more") - 1), lambda x: F.col("from").isNull() | (x < first) | (x >= first + F.col("blocks")))
    dealt = placed.select("doc_id", "cluster", block.alias("block"), F.explode(met).alias("other"))
    return dealt.select("doc_id", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _blocks() -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    return _near_duplicates(docs, bucketed(docs.select("doc_id", "text"), "doc_id"), threshold, size)


def _near_duplicates(docs: DataFrame, stored: DataFrame, threshold: int, size: int) -> DataFrame:
    sketched = written(sketches(docs, size), "sketches")
    linked = sketched.where("set_key is not null and doc_id is not null")
    classes = written(linked.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles")), "classes")
    members = linked.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").select("doc_id", "bands")
    buckets = members.select("doc_id", F.explode("bands").alias("band"))
    shared = written(buckets.groupBy("band").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("b < most"), "buckets")
    met = looked_up(buckets, "band", shared.select("band", "b"), hot=shared.where(F.col("n") > HOT).select("band"))
    ties = written(met.where("doc_id <> b").groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("n")), "ties")
    sizes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n_shingles").alias("n_shingles"))
    links = written(confirmed(stars(ties, sizes), stored, threshold, size), "star-links")
    joined = components(links)
    clusters = components(ties).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(sizes, "doc_id")
    clusters = clusters.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    clusters = written(clusters, "clusters")
    # two members have met already
    unsettled = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("n > 2 and low <> high").select("cluster")
    found = components(links.unionByName(confirmed(tiles(clusters.join(unsettled, "cluster")), stored, threshold, size)))
    of_class = classes.select("set_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("_component"))
    out = sketched.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, size: int = SIZE) -> DataFrame:
    """The rows of docs, all columns, that stand for their group: one for each; rows without doc_id stay. Of rows of one doc_id each different text stays, once."""
    stored = bucketed(docs, "doc_id")
    kept = _near_duplicates(stored, stored.select("doc_id", "text"), threshold, size).where("kept").select("doc_id").distinct()
    rows = stored.join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    ids = stored.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    if not ids.isEmpty():
        # of rows with equal doc_id and text the one whose other columns come first as JSON
        whole, others = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), F.lit(0))
        rows = rows.groupBy("doc_id", F.col("text").alias("_of_text")).agg(F.min_by(whole, F.to_json(others)).alias("_row")).select("_row.*")
    return rows.unionByName(stored.where("doc_id is null"))
