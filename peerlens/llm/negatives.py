"""Hard negatives by distributed radix selection over integer scores.

Anchors are a stated query set: every row whose vec_id is divisible by EVERY, against all rows, in blocks of at most BLOCK anchors. A block
(its vectors and thresholds, a few MB whatever the tables' size) is broadcast; rows stay where they are and are scored by one product of
matrices for each chunk. Selection of the first k rows of a score range ("window") goes digit by digit: tasks count scores by their
leading DIGIT bits below the top of the window, counts are added up, the bucket that holds the kth score is found, and the next pass
counts only inside it. After the last digit the kth score is known exactly; one more pass gathers the rows above it, and of those at
it as many as are missing, by vec_id. A task sends its buckets from the top until they hold k rows, since the kth score of all
rows can't lie below; so k counts and k rows a window and task at most are shuffled, however many rows tie.

An anchor's positives are found in the same way, in the window of all scores possible, among the rows of its label; its negatives in the
windows from its positives' scores, among the rows of other labels.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; vectors of different lengths are
compared as if the shorter one went on with zeros (an empty vector scores 0). Rows are told apart by vec_id: other rows than the anchor
are those with another vec_id. Repeated rows each count as candidates; an anchor whose vec_id is repeated asks once, with its least
label and vector. A row with a null vec_id is no anchor and comes last among ties. A positive with a negative score has an empty window; one
with score 0 takes scores of 0. Components beyond 2^27 in size raise an error, since scores might not fit a long. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written
from .hamerly import packed, scaled, unpacked, usable

EVERY = 100
RELABEL = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
BLOCK = 1024
DIGIT = 9
CHUNK = 2048
EXACT = 2**53


@dataclass
class Windows:
    """Score ranges by number: the anchor's place in the block, highest score and width, and whether rows of its label are meant."""

    anchor: np.ndarray
    high: np.ndarray
    span: np.ndarray
    same: bool
    k: int


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray


def prepared(embeddings: DataFrame, scale: int = SCALE, relabel: int = RELABEL, labels: int = LABELS) -> tuple[DataFrame, int]:
    """vec_id, label, v (packed integers), norm (squared): the rows that take part, as a table in the shared folder; and their length."""
    kept = embeddings.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    kept = kept.select("vec_id", label.cast("long").alias("label"), "embedding")
    dim = kept.agg(F.max(F.size("embedding"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            length = column.value_lengths().to_numpy(zero_copy_only=False)
            values = np.zeros((batch.num_rows, dim), np.int64)
            values[np.arange(dim)[None, :] < length[:, None]] = scaled(column.flatten().to_numpy(zero_copy_only=False), scale)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed(values.astype("<i4")), pa.array((values * values).sum(1))], names=["vec_id", "label", "v", "norm"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return written(kept.mapInArrow(run, f"vec_id {kind}, label bigint, v binary, norm bigint"), "negatives-rows"), dim


def _scores(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products, anchors by rows."""
    top = int(np.abs(matrix).max(initial=0)) * int(np.abs(v).max(initial=0)) * matrix.shape[1]
    if top >= 2**62:
        raise ValueError("scores would not fit a long")
    if top < EXACT:
        return (matrix.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return matrix.astype(np.int64) @ v.T.astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch], block: Block, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of rows: their ids, which ids are null, and window, row and distance below the top for all rows that fit a window."""
    dim = block.matrix.shape[1]
    slots = [np.flatnonzero(_nth(windows.anchor) == j) for j in range(int(_nth(windows.anchor).max(initial=-1)) + 1)]
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK):
            part = batch.slice(a, CHUNK)
            none = part.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            ids = part.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            scores = _scores(block.matrix, unpacked(part.column("v"), dim))
            fits = (block.labels[:, None] == part.column("label").to_numpy(zero_copy_only=False)[None, :]) == windows.same
            fits &= (block.ids[:, None] != ids[None, :]) | none[None, :]
            for slot in slots:  # at most one window of an anchor at a time
                at = windows.anchor[slot]
                below = windows.high[slot, None] - scores[at]
                w, row = np.nonzero(fits[at] & (below >= 0) & (below <= windows.span[slot, None]))
                yield ids, none, slot[w], row, below[w, row]


def _nth(groups: np.ndarray) -> np.ndarray:
    """The place of each entry within its group; groups lie together."""
    begins = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.arange(len(groups)) - np.repeat(begins, np.diff(np.append(begins, len(groups))))


def _histogram(rows: DataFrame, block: Block, windows: Windows, shift: int, prefix: np.ndarray, need: np.ndarray) -> DataFrame:
    """window, digit, n: counts of the digit at `shift` among scores that continue `prefix`, added up over all tasks."""
    send = rows.sparkSession.sparkContext.broadcast((block, windows, prefix, need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows, prefix, need = send.value
        size = len(windows.anchor) << DIGIT
        counts = np.zeros(size, np.int64)
        for _, _, w, _, below in _met(batches, block, windows):
            fits = (below >> (shift + DIGIT)) == prefix[w]
            counts += np.bincount((w[fits] << DIGIT) + ((below[fits] >> shift) & ((1 << DIGIT) - 1)), minlength=size)
        grid = counts.reshape(-1, 1 << DIGIT)
        w, digit = np.nonzero((grid > 0) & (grid.cumsum(1) - grid < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(digit), pa.array(grid[w, digit])], names=["window", "digit", "n"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, "window bigint, digit bigint, n bigint").groupBy("window", "digit").agg(F.sum("n").alias("n"))


def thresholds(rows: DataFrame, block: Block, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """For each window the distance of its kth row below the top, and how many rows at that distance belong to the first k.

    Windows with fewer than k rows have a distance beyond their span.
    """
    n = len(windows.anchor)
    prefix, need, full = np.zeros(n, np.int64), np.full(n, windows.k, np.int64), np.ones(n, bool)
    levels = max(1, -(-int(windows.span.max(initial=0)).bit_length() // DIGIT))
    for level in reversed(range(levels)):
        order = Window.partitionBy("window").orderBy("digit")
        counts = _histogram(rows, block, windows, level * DIGIT, np.where(full, prefix, -1), need).withColumn("sum", F.sum("n").over(order))
        wanted = rows.sparkSession.createDataFrame(pa.table({"window": np.arange(n), "need": need}))  # as many rows as the block has windows
        hit = counts.join(wanted, "window").where((F.col("sum") >= F.col("need")) & (F.col("sum") - F.col("n") < F.col("need")))
        got = hit.select("window", "digit", (F.col("sum") - F.col("n")).alias("before")).toArrow()  # one row a window
        w = got.column("window").to_numpy()
        found = np.zeros(n, bool)
        found[w] = True
        full &= found
        prefix[w] = (prefix[w] << DIGIT) + got.column("digit").to_numpy()
        need[w] -= got.column("before").to_numpy()
    return np.where(full, prefix, windows.span + 1), np.where(full, need, 0)


def selected(rows: DataFrame, block: Block, windows: Windows) -> DataFrame:
    """window, vec_id, score, rank: the first k rows of each window by descending score and vec_id."""
    edge, ties = thresholds(rows, block, windows)
    send = rows.sparkSession.sparkContext.broadcast((block, windows, edge, ties))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows, edge, ties = send.value
        held = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64)]
        for ids, none, w, row, below in _met(batches, block, windows):
            fits = (below < edge[w]) | ((below == edge[w]) & (ties[w] > 0))
            w, row, below = w[fits], row[fits], below[fits]
            held = [np.concatenate(x) for x in zip(held, (w, below, none[row], ids[row]))]
            if len(held[0]) > 4 * windows.k * len(windows.anchor):
                held = _first(held, edge, ties)
        w, below, none, ids = _first(held, edge, ties)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(ids, mask=none), pa.array(windows.high[w] - below)], names=["window", "vec_id", "score"])

    found = rows.select("vec_id", "label", "v").mapInArrow(run, "window bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.k)


def _first(held: list[np.ndarray], edge: np.ndarray, ties: np.ndarray) -> list[np.ndarray]:
    """What may still be among the first k: rows above the edge, and by vec_id as many at it as are missing."""
    w, below, none, ids = held
    order = np.lexsort((ids, none, below, w))
    w, below, none, ids = (x[order] for x in held)
    at = below == edge[w]
    keep = np.ones(len(w), bool)
    keep[at] = _nth(w[at]) < ties[w[at]]
    return [x[keep] for x in (w, below, none, ids)]


def _blocks(rows: DataFrame, dim: int, every: int, size: int) -> Iterator[Block]:
    """Anchors by ascending vec_id, at most `size` at a time."""
    anchors = written(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "v"), "negatives-anchors")
    last = None
    while True:
        left = anchors if last is None else anchors.where(F.col("vec_id") > last)
        got = left.orderBy("vec_id", "label", "v").limit(size).toArrow()
        if not len(got):
            return
        ids = got.column("vec_id").to_numpy()
        once = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        yield Block(ids[once], got.column("label").to_numpy()[once], unpacked(got.column("v").combine_chunks(), dim)[once])
        last = int(ids[-1])


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; one table in the shared folder takes the blocks' results."""
    spark = embeddings.sparkSession
    rows, dim = prepared(embeddings, scale)
    longest = rows.agg(F.max("norm")).first()[0] or 0
    path, kind = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}", "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], kind).write.parquet(path)
    for part in _blocks(rows, dim, every, block):
        norms = (part.matrix.astype(object) ** 2).sum(1) if dim else [0] * len(part.ids)
        reach = np.array([math.isqrt(int(x) * int(longest)) + 1 for x in norms], np.int64)  # no score is larger
        near = selected(rows, part, Windows(np.arange(len(part.ids)), reach, 2 * reach, True, positives)).orderBy("window", "rank").toArrow()  # at most `positives` rows an anchor
        score = [int(x) for x in near.column("score").to_pylist()]
        top, bottom = np.array([high * s // 100 for s in score], np.int64), np.array([-(-low * s // 100) for s in score], np.int64)
        some = np.flatnonzero(bottom <= top)
        if not len(some):
            continue
        anchor = near.column("window").to_numpy()
        found = selected(rows, part, Windows(anchor[some], top[some], (top - bottom)[some], False, negatives))
        names = spark.createDataFrame(pa.table({"window": np.arange(len(some)), "anchor_id": part.ids[anchor[some]], "positive_id": near.column("vec_id").combine_chunks().take(pa.array(some)), "positive_score": np.array(score, np.int64)[some]}))
        found.join(names, "window").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)
