"""Language-model scores by deleted interpolation of word trigrams, bigrams and unigrams.

Tokens are words (runs of bytes other than ASCII white space, A-Z lower-cased) and one end for each document; a document
begins after two ends. The model is

    P(w | u, v) = a * N(u v w) / N(u v) + b * N(v w) / N(v) + c * (N(w) + 1) / (N + V + 1)

N are counts of word trigrams, bigrams and unigrams over all training rows, all of them kept, those that occur once
too; unigrams take the add-one estimate (one place for all unknown words), so no token is impossible. a, b and c depend on
how often the context was seen (buckets by powers of two of N(u v), or of N(v) where u v is new). They are learned by
expectation-maximisation on deleted rows: training rows with crc32(doc_id) mod 7 = DELETED, whose n-grams are left out of
the estimates until the weights stand. For that the estimates of each deleted token are rounded to a third of a power
of ten and counted, so that the driver gets 2 * BUCKETS * LEVELS**3 counts at most.

N-grams reach their counts and come back without a row for each: rows are packed into blocks of about BLOCK_BYTES of
text (deleted rows in blocks of their own), a block's distinct n-grams are hashes in ascending order, cut into ranges of
the hash. A range of all blocks meets in one task (about RANGE_GRAMS n-grams), which sums them and answers each block with
the sums in the block's order; ranges of words also tell how many words there are. Hashes have SPARE bits more than it takes to
number all n-grams: a bigram or trigram is mistaken for another with a chance of 2**-SPARE; words have a space of their own with
WORD_BITS. Tables of n-grams grow with the input and are nowhere held as a whole.

Defined results: a null text counts as empty and has the end token only; a null doc_id is trained on and is
not held out; repeated rows are counted and scored each; without training rows every token is unknown.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, shuffle_partitions

DELETED = 3
HELD_OUT = 2
BUCKETS = 40
END = b"\n"
BLOCK_BYTES = 2 << 20
RANGE_GRAMS = 1_000_000
SPARE = 17
WORD_BITS = 56
LEVELS = 25  # rounded estimates: 0, and 10 ** -(k / 3)
TOTALS = -1  # the block whose answer is the number of words


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7


def blocks_of(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """block, deleted, size, ids, held and texts: rows packed until their texts reach `size` characters, deleted rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
        sizes = [0, 0]

        def close(out):
            nonlocal number
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.string())]
            row = [pa.array([x], k) for x, k in zip((number, out, sizes[out], *open_[out]), kinds, strict=True)]
            open_[out], sizes[out], number = ([], [], []), 0, number + 1
            return pa.RecordBatch.from_arrays(row, names=["block", "deleted", "size", "ids", "held", "texts"])

        for batch in batches:
            for i, f, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "fold", "text")), strict=True):
                out = f == DELETED
                for column, x in zip(open_[out], (i, f == HELD_OUT, t), strict=True):
                    column.append(x)
                sizes[out] += len(t or "") + 16
                if sizes[out] >= size:
                    yield close(out)
        for out in (False, True):
            if open_[out][0]:
                yield close(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).cast("int").alias("fold"), "text")
    return bucketed(rows.mapInArrow(run, "block long, deleted boolean, size long, ids array<long>, held array<boolean>, texts array<string>"), "block")


class Words(dict):
    """Numbers of words as they come, with the hash of each; bounded by trim()."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q")
        self.end = self[END]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        return n

    def trim(self, limit: int = 400_000):
        if len(self) > limit:
            self.clear()
            self.hashes = array("Q")
            self.end = self[END]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that moves each bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """The n-grams of a block as hashes: words of WORD_BITS, bigrams and trigrams of `bits` bits behind them."""

    def __init__(self, texts: list[str | None], words: Words, bits: int):
        each = [tokens(t) for t in texts]
        self.lengths = np.array([len(t) for t in each], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.n = n = int(self.lengths.sum())
        w = np.fromiter(map(words.__getitem__, chain.from_iterable(each)), np.int64, n)
        v = self._before(w, words.end)
        u = self._before(v, words.end)
        h = np.array(words.hashes, np.uint64)
        self.words, self.w = h >> np.uint64(64 - WORD_BITS), w
        two = _mix(h + np.uint64(2))[v] + h[w]
        three = _mix(_mix(h + np.uint64(3))[u] + h[v]) + h[w]
        self.more = (_mix(np.concatenate([two, three])) >> np.uint64(64 - bits)) + np.uint64(1 << WORD_BITS)

    def counted(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes and how often each stands at tokens that are not held out."""
        size = len(self.words)
        met = np.flatnonzero(np.bincount(self.w, minlength=size))
        order = met[np.argsort(self.words[met])]
        # the mark of a held-out token is the lowest bit
        marked = np.sort(self.more << np.uint64(1) | np.tile(held, 2).astype(np.uint64))
        keys = np.concatenate([self.words[order], marked >> np.uint64(1)])
        counts = np.concatenate([np.bincount(self.w[~held], minlength=size)[order], 1 - (marked & np.uint64(1)).astype(np.int64)])
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)))
        return keys[first], np.add.reduceat(counts, first)

    def places(self) -> np.ndarray:
        """For each token the place of its word, bigram and trigram among the distinct hashes."""
        met = np.flatnonzero(np.bincount(self.w, minlength=len(self.words)))
        one, at = np.unique(self.words[met], return_inverse=True)
        rank = np.zeros(len(self.words), np.int64)
        rank[met] = at
        return np.concatenate([rank[self.w], np.unique(self.more, return_inverse=True)[1] + len(one)])

    def _before(self, x: np.ndarray, first: int) -> np.ndarray:
        out = np.roll(x, 1)
        out[self.starts] = first
        return out

    def spread(self, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """N(w), N(v w), N(u v w), N(v) and N(u v) at each token, from the counts of the distinct n-grams."""
        one, two, three = np.split(counts[self.places()], 3)
        # a context is seen as often as it stands: the end begins a document as often as it ends one
        ends = one[self.lengths[0] - 1]
        return one, two, three, self._before(one, ends), self._before(two, ends)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)


_ZSTD = pa.Codec("zstd", 1)


def pack(values: np.ndarray, whole: bool = True) -> bytes:
    """Non-negative integers as planes of bytes, no wider than the greatest needs, compressed; or the plane of the highest bytes only."""
    most = int(values.max()) if len(values) else 0
    width = max(1, -(-most.bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    low = 0 if whole else (width - 1) * len(values)
    return bytes([width]) + planes[:low] + _ZSTD.compress(planes[low:], asbytes=True)


def unpack(packed: bytes, n: int, whole: bool = True) -> np.ndarray:
    width = packed[0]
    low = 0 if whole else (width - 1) * n
    planes = packed[1 : 1 + low] + _ZSTD.decompress(packed[1 + low :], width * n - low, asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def gram_counts(blocks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """block, found: for each block its ranges in order, each with the counts over all training rows (`n_all`) of the block's distinct n-grams in it, and those over kept rows for deleted blocks (`n_kept`).
    Block TOTALS has, for each range of words, tokens and distinct words of all training rows in n_all, of kept rows in n_kept."""
    # words are about a tenth of all
    few = -(-ranges // 10)
    firsts = [k * ((1 << WORD_BITS) // few + 1) for k in range(few)] + [(1 << WORD_BITS) + k * ((1 << bits) // ranges + 1) for k in range(ranges)]
    firsts = np.array(firsts, np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for r in range(batch.num_rows):
                block, deleted, held, texts = (batch.column(c)[r].as_py() for c in ("block", "deleted", "held", "texts"))
                g = Grams(texts, words, bits)
                hashes, counts = g.counted(np.repeat(held, g.lengths))
                ends = [*np.searchsorted(hashes, firsts), len(hashes)]
                rows = [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array([deleted] * len(rows), pa.bool_()),
                        pa.array([k for k, _, _ in rows], pa.int32()),
                        pa.array([b - a for _, a, b in rows], pa.int32()),
                        pa.array([pack(np.diff(hashes[a:b], prepend=firsts[k]), False) for k, a, b in rows], pa.binary()),
                        pa.array([pack(counts[a:b]) for _, a, b in rows], pa.binary()),
                    ],
                    names=["block", "deleted", "range", "n", "grams", "counts"],
                )
                words.trim()

    def answer(table: pa.Table) -> pa.Table:
        ns, first = table.column("n").to_pylist(), firsts[table.column("range")[0].as_py()]
        grams = np.concatenate([np.cumsum(unpack(x, n, False), dtype=np.uint64) + first for x, n in zip(table.column("grams").to_pylist(), ns, strict=True)])
        counts = np.concatenate([unpack(x, n) for x, n in zip(table.column("counts").to_pylist(), ns, strict=True)])
        deleted = table.column("deleted").to_pylist()
        at = np.unique(grams, return_inverse=True)[1]
        ends = np.cumsum(ns)[:-1]
        # sums are exact: below 2 ** 53
        n_all = np.bincount(at, counts).astype(np.int64)
        n_kept = np.bincount(at, np.where(np.repeat(deleted, ns), 0, counts)).astype(np.int64)
        parts = list(zip(np.split(at, ends), deleted, strict=True))
        k, columns = table.column("range")[0].as_py(), [[pack(n_all[x]) for x, _ in parts], [pack(n_kept[x]) if d else None for x, d in parts]]
        out = [table.column("block").to_pylist(), ns, *columns]
        if k < few:
            for column, x in zip(out, (TOTALS, 2, *(pack(np.array([c.sum(), np.count_nonzero(c)])) for c in (n_all, n_kept))), strict=True):
                column.append(x)
        kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary()
        block, n, all_, kept = (pa.array(column, kind) for column, kind in zip(out, kinds, strict=True))
        return pa.table([block, pa.array([k] * len(n), pa.int32()), n, all_, kept], names=["block", "range", "n", "n_all", "n_kept"])

    asked = blocks.mapInArrow(ask, "block long, deleted boolean, range int, n int, grams binary, counts binary")
    answered = asked.groupBy("range").applyInArrow(answer, "block long, range int, n int, n_all binary, n_kept binary")
    return bucketed(answered.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "n", "n_all", "n_kept"))).alias("found")), "block")


def _found(found: list[dict], column: str) -> np.ndarray:
    return np.concatenate([unpack(f[column], f["n"]) for f in found]).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def estimates(g: Grams, counts: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each token: N(w), the bucket of the context, and the trigram, bigram and unigram estimates (3 rows)."""
    one, two, three, v, uv = g.spread(counts)
    power = np.minimum(np.frexp(np.where(uv > 0, uv, v).astype(float))[1], BUCKETS - 1)
    bucket = np.where(uv > 0, power, BUCKETS + power)
    return one, bucket, np.stack([_ratio(three, uv), _ratio(two, v), (one + 1) / (total + distinct + 1)])


def deleted_counts(joined: DataFrame, total: int, distinct: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (bucket and three rounded estimates) that tokens of deleted rows fall into, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        count = np.zeros(2 * BUCKETS * LEVELS**3, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                texts, found = (batch.column(c)[r].as_py() for c in ("texts", "found"))
                g = Grams(texts, words, bits)
                _, bucket, p = estimates(g, _found(found, "n_kept"), total, distinct)
                level = np.where(p > 0, np.clip(np.rint(-3 * np.log10(np.where(p > 0, p, 1))), 0, LEVELS - 2) + 1, 0).astype(np.int64)
                code = ((bucket * LEVELS + level[0]) * LEVELS + level[1]) * LEVELS + level[2]
                cells, n = np.unique(code, return_counts=True)
                count[cells] += n
                words.trim()
        cells = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(count[cells], pa.int64())], names=["cell", "n"])

    # at most 2 * BUCKETS * LEVELS ** 3 rows
    met = joined.where("deleted").select("texts", "found").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return met.column("cell").to_numpy(), met.column("n").to_numpy()


def interpolation_weights(cell: np.ndarray, n: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (2 * BUCKETS, 3) of trigram, bigram and unigram estimates, by EM on the counts of deleted tokens."""
    value = np.array([0.0, *(10 ** -(np.arange(LEVELS - 1) / 3))])
    p = value[np.stack([cell // LEVELS**2 % LEVELS, cell // LEVELS % LEVELS, cell % LEVELS], 1)]
    bucket = cell // LEVELS**3
    # no trigram estimate where u v is new, no bigram estimate where v is new too
    may = np.ones((2 * BUCKETS, 3))
    may[BUCKETS:, 0] = 0
    may[BUCKETS, 1] = 0
    weights = may / may.sum(1, keepdims=True)
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
        # a bucket that no deleted row reaches keeps even weights; no part vanishes
        gained = (np.stack([np.bincount(bucket, part[:, j], 2 * BUCKETS) for j in range(3)], 1) + 1e-3) * may
        weights = gained / gained.sum(1, keepdims=True)
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    blocks = blocks_of(docs)
    # about six characters a token with its separator, two distinct n-grams a token at most
    size = (blocks.agg(F.sum("size").alias("size")).first()["size"] or 0) // 6
    bits = min(WORD_BITS, max(40, (2 * size).bit_length() + SPARE))
    found = gram_counts(blocks, max(2 * shuffle_partitions(docs.sparkSession), -(-2 * size // RANGE_GRAMS)), bits)
    # one row, two numbers for each range of words
    sums = found.where(F.col("block") == TOTALS).first()
    total, distinct, kept, kept_distinct = (int(sum(unpack(f[c], 2)[k] for f in sums["found"])) if sums else 0 for c in ("n_all", "n_kept") for k in (0, 1))
    joined = blocks.join(found, "block")
    weights = interpolation_weights(*deleted_counts(joined, kept, kept_distinct, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for r in range(batch.num_rows):
                ids, held, texts, found = (batch.column(c)[r].as_py() for c in ("ids", "held", "texts", "found"))
                g = Grams(texts, words, bits)
                one, bucket, p = estimates(g, _found(found, "n_all"), total, distinct)
                mixed = (weights[bucket].T * p).sum(0)
                base = g.sums(np.log10(one + 1)) - g.lengths * log10(total + distinct + 1)
                columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(g.lengths), pa.array(g.sums((one > 0).astype(np.int64))), pa.array([total] * len(ids), pa.int64()), pa.array(base), pa.array(g.sums(np.log10(mixed)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                words.trim()

    return joined.select("ids", "held", "texts", "found").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
