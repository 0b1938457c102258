"""Token-id files: one concatenated id array per block, document boundaries in Elias-Fano form.

File format (Parquet, so that any store Spark knows can hold it, commits are atomic and a lost executor's
part is written again): one row is one block of up to BLOCK_IDS ids of whole documents (one longer document
makes a block of its own), in ascending (bucket, block) = ascending doc_id order, with

    bucket int, block int      place of the block
    before long                ids of the bucket's earlier blocks
    n_docs long, n_ids long    its documents and ids
    width int                  bytes of an id: 2 if the vocabulary fits 65,536, else 4
    ids binary                 ids, little-endian, end id after each document
    doc_ids binary             signed 64-bit little-endian; nulls binary: one byte for each document
    low_bits int, low binary, high binary, marks binary
                               Elias-Fano code of the n_docs + 1 boundaries: low_bits bits of each
                               boundary packed in `low`; the rest in unary in `high`; `marks` holds the
                               place of each SELECT_STEP-th one bit of `high` for select in O(step).

No 64-bit offset table is stored: select(i) gives boundary i from about 2 + log2(n_ids / n_docs) bits.

Encoding goes by white-space pieces with a bounded cache in front of the library: the normaliser drops
ASCII white space and neither the pattern nor the merges cross it, so a text's ids are those of its pieces.

Defined results: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids stand in
the order of their texts; an empty table gives no blocks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIN_LONG, bucket_count, bucket_of, order_bounds, written

BLOCK_IDS = 2_000_000
SELECT_STEP = 64
CACHE = 700_000

FILE_SCHEMA = "bucket int, block int, before long, n_docs long, n_ids long, width int, ids binary, doc_ids binary, nulls binary, low_bits int, low binary, high binary, marks binary"


class EliasFano:
    """Ascending non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, marks: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.marks = np.frombuffer(marks, np.uint32)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        n, most = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, int(np.log2(most / n))) if n and most > n else 0
        v = values.astype(np.uint64)
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places.astype(np.int64)] = 1
        return bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SELECT_STEP].astype(np.uint32).tobytes()

    def select(self, i: int) -> int:
        """The i-th value."""
        at = int(self.marks[i // SELECT_STEP])
        left = i % SELECT_STEP
        byte = at // 8
        ones = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (c := ones.bit_count()) <= left:
            left -= c
            byte += 1
            ones = int(self.high[byte])
        for _ in range(left):
            ones &= ones - 1
        place = byte * 8 + (ones & -ones).bit_length() - 1
        low = 0
        for b in range(self.low_bits):
            k = i * self.low_bits + b
            low |= (int(self.low[k // 8]) >> (k % 8) & 1) << b
        return (place - i) << self.low_bits | low

    def selects(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i, each found from its mark; all of them step together."""
        at = self.marks[i // SELECT_STEP].astype(np.int64)
        left, byte = i % SELECT_STEP, at // 8
        ones = self.high[byte] >> (at % 8).astype(np.uint8) << (at % 8).astype(np.uint8)
        on = np.flatnonzero(_ONES[ones] <= left)
        while len(on):
            left[on] -= _ONES[ones[on]]
            byte[on] += 1
            ones[on] = self.high[byte[on]]
            on = on[_ONES[ones[on]] <= left[on]]
        high = byte * 8 + _NTH[ones, left] - i
        low = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            k = i * self.low_bits + b
            low |= (self.low[k // 8] >> (k % 8).astype(np.uint8) & 1).astype(np.int64) << b
        return high << self.low_bits | low


#: of each byte: how many ones it has, and where its k-th one is
_ONES = np.array([b.bit_count() for b in range(256)], np.int64)
_NTH = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class PieceCache(dict):
    """Bytes of a piece's ids, made when first asked for; two generations of bounded size, so that frequent pieces stay."""

    def __init__(self, encode, limit: int = CACHE):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        b = self.old.get(piece)
        if b is None:
            b = self.encode(piece)
        self[piece] = b
        return b

    def ids(self, texts: list[str | None]) -> list[bytes]:
        get = self.__getitem__
        out = [b"".join(map(get, pieces_of(t))) for t in texts]
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        return out


class PieceEncoder:
    """Ids of white-space pieces by the library.

    A piece is first brought to lower case, and one full stop or comma behind a letter is taken off, as the library's
    normaliser and pattern do; what is then a run of Latin letters is one pre-token, in normal form, and goes straight
    to the library's merges in its byte alphabet. Any other piece takes the library's whole way.
    """

    def __init__(self, library, kind: np.dtype):
        self.library, self.kind = library, "H" if kind.itemsize == 2 else "I"
        self.merge = library.model.tokenize
        # the byte alphabet: printable bytes stand for themselves, the others for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}
        self.marks = {m: self._whole(m) for m in ".,"}

    def _whole(self, piece: str) -> bytes:
        return array(self.kind, self.library.encode(piece, add_special_tokens=False).ids).tobytes()

    def __call__(self, piece: str) -> bytes:
        mark = piece[-1] if piece[-1] in ".," and len(piece) > 1 else ""
        word = (piece[:-1] if mark else piece).lower()
        if not _LATIN(word):
            return self._whole(piece)
        in_bytes = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        b = array(self.kind, [t.id for t in self.merge(in_bytes)]).tobytes()
        return b + self.marks[mark] if mark else b


#: a-z and the lower-case letters of Latin-1 and Latin Extended-A and -B but for those whose forms depend on more than the letter
_LATIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+").fullmatch
_loaded: dict[str, tuple[PieceCache, np.dtype]] = {}


def _piece_cache(path: str) -> tuple[PieceCache, np.dtype]:
    """One for each worker process: later tasks find the pieces of earlier ones."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        kind = np.dtype("<u2") if library.get_vocab_size(with_added_tokens=True) <= 65_536 else np.dtype("<u4")
        _loaded[path] = (PieceCache(PieceEncoder(library, kind)), kind)
    return _loaded[path]


_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_ASCII_SPACE = re.compile(r"[\t\n\x0b\f\r ]+")


def pieces_of(text: str | None) -> list[str]:
    """White-space pieces. str.split() also cuts at \\x1c-\\x1f, which are no white space to the library."""
    if not text:
        return []
    if any(c in text for c in _SEPARATORS):
        return [p for p in _ASCII_SPACE.split(text) if p]
    return text.split()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes docs and writes the files; returns them as read back (FILE_SCHEMA)."""
    rows = docs.select("doc_id", "text").withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)))
    n = bucket_count(rows)
    bounds = order_bounds(rows, "_key", n)
    rows = rows.withColumn("_bucket", bucket_of(F.col("_key"), bounds).cast("int"))
    dealt = rows.repartition("_bucket").sortWithinPartitions("_bucket", "_key", F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, kind = _piece_cache(tokenizer)
        end = np.array([end_id], kind).tobytes()
        at, block, before = None, 0, 0
        ids: list[bytes] = []
        doc_ids: list[int] = []
        nulls: list[bool] = []
        size = 0

        def close():
            nonlocal ids, doc_ids, nulls, size, block, before
            bounds = np.cumsum([0, *(len(x) // kind.itemsize for x in ids)])
            bits, low, high, marks = EliasFano.encode(bounds)
            out = {"bucket": at, "block": block, "before": before, "n_docs": len(ids), "n_ids": int(bounds[-1]), "width": kind.itemsize, "ids": b"".join(ids), "doc_ids": np.array(doc_ids, "<i8").tobytes(), "nulls": np.array(nulls, np.uint8).tobytes(), "low_bits": bits, "low": low, "high": high, "marks": marks}
            ids, doc_ids, nulls, size, block, before = [], [], [], 0, block + 1, before + out["n_ids"]
            return pa.RecordBatch.from_pylist([out], schema=FILE_ARROW)

        for batch in batches:
            buckets, keys = batch.column("_bucket").to_pylist(), batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 512):
                made = cache.ids(texts[a : a + 512])
                for b, k, x in zip(buckets[a : a + 512], keys[a : a + 512], made, strict=True):
                    if ids and (b != at or size >= block_ids):
                        yield close()
                    if b != at:
                        at, block, before = b, 0, 0
                    ids.append(x + end)
                    doc_ids.append(0 if k is None else k)
                    nulls.append(k is None)
                    size += len(ids[-1]) // kind.itemsize
        if ids:
            yield close()

    return written(dealt.mapInArrow(run, FILE_SCHEMA), "token-files")


FILE_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("marks", pa.binary())])


def with_base(files: DataFrame) -> DataFrame:
    """Adds `base`: the ids of all blocks before. There are at most 65,536 buckets, so their totals can be broadcast."""
    totals = files.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(F.broadcast(totals.select("bucket", earlier.alias("_earlier"))), "bucket").withColumn("base", F.col("_earlier") + F.col("before"))


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files; starts and ends come by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                places = EliasFano(r["n_docs"] + 1, r["low_bits"], r["low"], r["high"], r["marks"])
                bounds = places.selects(np.arange(r["n_docs"] + 1))
                ids = np.frombuffer(r["ids"], "<u2" if r["width"] == 2 else "<u4").astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["nulls"], np.uint8).astype(bool)),
                        pa.array(bounds[:-1] + r["base"], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a few blocks at a time: each may hold megabytes
    return with_base(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
