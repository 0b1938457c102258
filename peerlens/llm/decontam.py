"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of the items, each text scanned once.

Texts and items are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII bytes; every window
of WINDOW consecutive item words (a shorter item as a whole) is a pattern, words parted by single spaces with one
space at either end. The scan runs over the normalised UTF-8 bytes; match ends are mapped to word numbers, and
spans() maps those to code-point offsets in the original text.

An automaton holds at most about MAX_WORDS item words (some 3 KB of memory a word) and is built once in a worker process.
A larger benchmark is dealt to blocks by a hash, long items in pieces that overlap by WINDOW - 1 words; each block is one pass over the
texts, whose hits (rows that are hit only) are written, and the hits of all passes are joined to the rows by doc_id and
a 128-bit hash of the text. So one automaton is alive at a time, and nothing is dropped. With one block there is no shuffle and no
second pass. The driver sees one block of item words at a time.

Defined results: null or wordless texts have no words and no hits; an item without words has no window;
equal windows of several items count for each of them; an item without item_id hits but has no name; repeated rows
each get a result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
MAX_WORDS = 150_000
PIECE = 5_000
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20) for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[str, str | None]]):
    """items: (item id as text, text). Each pattern's value: its length in words and the numbers of its items."""
    import ahocorasick

    found: dict[bytes, tuple[int, set[int]]] = {}
    for k, (_, text) in enumerate(items):
        for w in windows_of(words_of(text)):
            found.setdefault(w, (w.count(b" ") + 1, set()))[1].add(k)
    built = ahocorasick.Automaton()
    for w, (n, ids) in found.items():
        built.add_word(f" {w.decode('latin-1')} ", (n, sorted(ids)))
    built.make_automaton()
    return built


def scan(built, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Runs of hit words [first, end) in order, without overlap, and the numbers of the items found."""
    if not words or not len(built):
        return [], set()
    line = " " + b" ".join(words).decode("latin-1") + " "
    met = list(built.iter(line))
    if not met:
        return [], set()
    spans, items = [], set()
    word, at = 0, 1  # words before `at`; matches come by ascending end
    for end, (n, ids) in met:
        word += line.count(" ", at, end + 1)
        at = end + 1
        items.update(ids)
        spans.append((word - n, word))
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs, items


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets [start, end) in the original text of runs of words."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def pieces(benchmark: DataFrame) -> DataFrame:
    """item, n_words and text (normalised) of each item, those of more than PIECE words cut into pieces that hold each window once at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for i in range(0, max(len(words) - WINDOW + 1, 1), PIECE) if words else ():
                    part = words[i : i + PIECE + WINDOW - 1]
                    rows.append((item, len(part), b" ".join(part).decode("utf-8", "surrogatepass")))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["item", "n_words", "text"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, n_words long, text string")


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """Blocks of about `limit` words, one after the other; empty ones are left out."""
    cut = pieces(benchmark)
    total = cut.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    if total <= limit:
        block = cut.select("item", "text").collect()
        yield [(r[0], r[1]) for r in block]
        return
    # half full on average, so that the hash leaves room
    n = -(-2 * total // limit)
    cut = written(cut.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "benchmark-pieces")
    for k in range(n):
        block = cut.where(F.col("block") == k).select("item", "text").collect()
        if block:
            yield [(r[0], r[1]) for r in block]


_BUILT: dict = {}


def _share(spark, block: list):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, block))


def _loaded(shared) -> tuple:
    """The automaton of a broadcast block and the block, built once in a worker process, which holds one at a time."""
    name, block = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = automaton(block), block
    return _BUILT[name]


_RUN = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
FOUND = "runs array<struct<first: int, end: int>>, items array<string>"


def _pass(rows: DataFrame, shared, keys: tuple[str, ...], hits_only: bool) -> DataFrame:
    """keys, n_words, runs and items of each row (or each that is hit) under one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, block = _loaded(shared)
        for batch in batches:
            n_words, runs, found = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                own, ids = scan(built, words)
                n_words.append(len(words))
                runs.append([{"first": a, "end": b} for a, b in own])
                found.append(sorted({block[k][0] for k in ids} - {None}))
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(n_words, pa.int64()), pa.array(runs, _RUN), pa.array(found, pa.list_(pa.string()))], names=[*keys, "n_words", "runs", "items"])
            yield out.filter(pa.array([bool(r) for r in runs], pa.bool_())) if hits_only else out

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys]
    by_name = {k.split("`")[1]: k for k in kept}
    return rows.select(*keys, "text").mapInArrow(run, ", ".join([*(by_name[k] for k in keys), "n_words long", FOUND]))


_HASHES = ("_hash", "_more")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_hash": F.xxhash64("text"), "_more": F.xxhash64(F.lit(7), "text")})


def _merge(runs) -> list[dict]:
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["first"], r["end"])):
        if out and r["first"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], r["end"])
        else:
            out.append({"first": r["first"], "end": r["end"]})
    return out


def _hits(rows: DataFrame, blocks: list, spark) -> DataFrame:
    """_hash, _more, runs and items of texts that are hit by any block, one pass a block."""
    found = None
    for block in blocks:
        shared = _share(spark, block)
        hits = written(_pass(rows, shared, _HASHES, True), "benchmark-hits")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    merge = F.pandas_udf(lambda s: s.map(_merge), "array<struct<first: int, end: int>>")
    # at most one row for each block and text after equal texts are one
    once = found.dropDuplicates([*_HASHES, "items", "runs"]).groupBy(*_HASHES).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return once.withColumn("runs", merge("runs"))


def _first_blocks(benchmark: DataFrame, limit: int):
    """The first block, and an iterator over all blocks if there are more."""
    blocks = _blocks(benchmark, limit)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return first, None
    return first, chain([first, second], blocks)


def scan_documents(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, runs of hit words and item ids of each row; further columns of docs named in extra are kept, which must have other names."""
    if clash := {"doc_id", "text", "n_words", "runs", "items", *_HASHES} & set(extra):
        raise ValueError(f"columns of the result can't be kept: {sorted(clash)}")
    spark = docs.sparkSession
    first, all_blocks = _first_blocks(benchmark, max_words)
    rows = docs.select("doc_id", "text", *extra)
    order = ["doc_id", "n_words", "runs", "items", *extra]
    if all_blocks is None:
        return _pass(rows, _share(spark, first), ("doc_id", *extra), False).select(*order)
    rows = _hashed(rows)
    hits = written(_hits(rows, all_blocks, spark), "benchmark-hits")
    plain = _pass(rows, _share(spark, []), ("doc_id", *_HASHES, *extra), False).drop("runs", "items")
    out = plain.join(hits, list(_HASHES), "left")
    return out.withColumns({"runs": F.coalesce("runs", F.expr("array()").cast("array<struct<first: int, end: int>>")), "items": F.coalesce("items", F.expr("array()").cast("array<string>"))}).select(*order)


def clean(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of docs, all columns, in which no window of an item occurs."""
    spark = docs.sparkSession
    first, all_blocks = _first_blocks(benchmark, max_words)
    if all_blocks is not None:
        hits = _hits(_hashed(docs.select("text")), all_blocks, spark).select(*_HASHES)
        met = (F.xxhash64(docs["text"]) == hits["_hash"]) & (F.xxhash64(F.lit(7), docs["text"]) == hits["_more"])
        return docs.join(hits, met, "left_anti")
    shared = _share(spark, first)

    @F.pandas_udf("boolean")
    def untouched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built, _ = _loaded(shared)
        for texts in batches:
            yield texts.map(lambda t: not scan(built, words_of(t))[0]).astype(bool)

    return docs.where(untouched(F.coalesce("text", F.lit(""))))


def digest(scanned: DataFrame) -> DataFrame:
    """The flat columns of a scan."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["first"]).cast("long"))
    return scanned.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )
