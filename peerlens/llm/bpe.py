"""Byte-level BPE with a hierarchical-bitmap rank queue, and its decoder.

All new pre-tokens of a batch of texts form one doubly linked list of parts (parted by barriers, so nothing
merges across). A bucket for each merge rank holds the list positions whose part and next part make that
rank; two levels of bitmaps over the ranks mark the non-empty buckets, and find-first-set gives the lowest
rank in constant time. Entries that no longer match their position are stale and skipped. The queue's work
grows with the merges and not with their logarithm or the square of a pre-token's length, so very long pre-tokens are
no special case. Within a bucket positions are taken from left to right, as the reference encoders do.

Pre-tokens met before are looked up in a bounded two-generation cache.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows each get a result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CACHE = 500_000
WORD_BITS = 256


class RankQueue:
    """Buckets of positions by rank; push in O(1), the lowest rank by find-first-set on two bitmap levels."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * (ranks // WORD_BITS + 1)
        self.top = 0

    def fill(self, rank: int, positions: list[int]) -> None:
        """Opens an empty bucket; later positions are appended to it."""
        self.buckets[rank] = positions
        word = rank >> 8
        self.words[word] |= 1 << (rank & 255)
        self.top |= 1 << word

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and all its positions."""
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        bits ^= low
        self.words[word] = bits
        if not bits:
            self.top ^= 1 << word
        rank = word << 8 | (low.bit_length() - 1)
        return rank, self.buckets.pop(rank)


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # rank of the joined bytes, by the two parts' ids: the only pairs that can ever merge
        self.pairs: dict[int, int] = {}
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = r
        self.of_bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)

    def encode(self, pretokens: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token, all merged through one queue."""
        if not pretokens:
            return []
        # a barrier (-1) before, between and after the pre-tokens: no pair with it has a rank
        data = np.frombuffer(b"\0" + b"\0".join(pretokens) + b"\0", np.uint8)
        ends = np.cumsum(np.array([len(p) + 1 for p in pretokens], np.int64))
        barrier = np.zeros(len(data), bool)
        barrier[0] = True
        barrier[ends] = True
        ids = self.single[data]
        ids[barrier] = -1
        rank_at = np.append(np.where(barrier[:-1] | barrier[1:], -1, self.of_bytes[data[:-1], data[1:]]), -1)
        part, at = ids.tolist(), rank_at.tolist()
        following = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        queue = RankQueue(len(self.tokens))
        places = np.flatnonzero(rank_at >= 0)
        places = places[np.argsort(rank_at[places], kind="stable")]
        ranks, begins = np.unique(rank_at[places], return_index=True)
        ordered, begins = places.tolist(), [*begins.tolist(), len(places)]
        for k, rank in enumerate(ranks.tolist()):
            queue.fill(rank, ordered[begins[k] : begins[k + 1]])
        pair, buckets, open_ = self.pairs.get, queue.buckets, queue.fill
        while (got := queue.pop()) is not None:
            rank, positions = got
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                if at[i] != rank:
                    continue  # stale: merged away, or a part has grown
                j = following[i]
                k = following[j]
                part[i] = rank
                part[j] = -2
                at[j] = -1
                following[i] = k
                before[k] = i
                r = at[i] = pair(rank << 20 | part[k], -1)
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        open_(r, [i])
                h = before[i]
                r = at[h] = pair(part[h] << 20 | rank, -1)
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(h)
                    else:
                        open_(r, [h])
        out, start = [], 1
        for end in ends.tolist():
            out.append([x for x in part[start:end] if x >= 0])
            start = end + 1
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, through the cache."""

    def __init__(self, path: str, pattern: str, limit: int = CACHE):
        import regex

        self.encoder = Encoder(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.new)
        if self.old:
            found = {p: b for p in new if (b := self.old.get(p)) is not None}
            self.new.update(found)
            new.difference_update(found)
        missing = list(new)
        made = self.encoder.encode([p.encode("utf-8", "replace") for p in missing])
        self.new.update((p, array("I", ids).tobytes()) for p, ids in zip(missing, made, strict=True))
        get = self.new.__getitem__
        out = [b"".join(map(get, ps)) for ps in cut]
        for p in missing:
            if len(p) > 64:
                del self.new[p]  # the cache's bytes stay bounded
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return self.encoder.decode(np.frombuffer(ids, "<u4").tolist())


_encoders: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(path, pattern)
    return _encoders[path, pattern]


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of docs named in keep, n_tokens and ids (binary, little-endian unsigned 32-bit) of each text."""
    path, pattern = _default(path, pattern)
    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(made, pa.binary())], names=[*keep, "n_tokens", "ids"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long", "ids binary"]))


def decode_ids(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bytes of each row's ids."""
    path, pattern = _default(path, None)
    rows = encoded.select(*keep, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in batches:
            out = [encoder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "decoded"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "decoded binary"]))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes: encode and decode in one pass over the texts."""
    path, pattern = _default(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                back = [hashlib.sha256(encoder.decode(x)).hexdigest() for x in made]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in made]), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
