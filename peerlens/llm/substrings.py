"""Removal of repeated substrings: every byte covered by a string of LENGTH bytes that also starts earlier.

1. Each window of LENGTH bytes has an anchor: the least hash of its 69 stretches of GRAM bytes, the leftmost in a
   tie. Equal windows have equal anchors at equal offsets, so only windows of one anchor hash need to meet. An
   anchor with the run of windows it stands for is one row; a text has about one for 36 bytes.
2. Rows with equal anchor and equal hash of the bytes around it are taken for repeats of the earliest as a whole. This is told
   first within each batch, so a passage in a third of all documents leaves a task once, and then by anchor. Runs that repeat the
   same earlier text side by side become one range, and each range is confirmed by the SHA-256 of its bytes and of
   those it repeats. Anchors of a range that isn't go through step 3 with all their rows.
3. Where an anchor still has different surroundings, the earliest of each kind send their bytes (a run's windows,
   about 136 bytes). Blocks of whole anchor groups are suffix-sorted in two stages, and adjacent
   common prefixes of LENGTH bytes tell the windows that start earlier as well (suffixes.py). So that a block stays bounded,
   anchors of more than GROUP kinds (a passage that stands between different words each time) go another way: their
   windows are dealt one by one by a 128-bit digest, and the least place of each is found by a combined aggregation.
4. A document's ranges meet its text once more, and the rest is put together.

The texts are kept in a bucketed table for steps 3 and 4 and are not shuffled. Order is (doc_id, start); rows of
equal doc_id are one place each and never remove each other's bytes at the same start. Defined results: null counts as empty;
texts below LENGTH bytes are kept; a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import MIN_LONG, bucketed, fresh, written
from .components import HOT, looked_up
from .shingles import mix
from .suffixes import repeated_windows

LENGTH = 100
GRAM = 32
CHUNK = 1 << 18
GROUP = 20_000
HELD = 200_000
BROADCAST_ROWS = 500_000
BLOCK_BYTES = 1 << 20


def anchors(data: np.ndarray, doc_end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Hash, surroundings, first window and number of windows of each anchor in joined texts.

    data: bytes of several texts; doc_end: for each byte, the end of its text.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    x = data.astype(np.uint64) + np.uint64(1)
    h, p, size = x, shingles._BASE, 1
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(p) + h[size:]
        p, size = p * p % 2**64, 2 * size
    value = mix(h)
    span = length - GRAM + 1
    at = np.arange(len(value), dtype=np.int32)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        left = value[: len(value) - step] <= value[step:]
        at = np.where(left, at[: len(at) - step], at[step:])
        value = np.where(left, value[: len(value) - step], value[step:])
        reach += step
    window = np.flatnonzero(np.arange(len(at)) + length <= doc_end[: len(at)])
    if not len(window):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    q = at[window]
    begins = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (window[1:] != window[:-1] + 1)]))
    first = window[begins]
    count = np.diff(np.append(begins, len(window)))
    shingles._grow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(x) * shingles._powers[:n], out=total[1:])
    end = first + count - 1 + length
    around = (total[end] - total[first]) * shingles._inverse[first]
    around = mix(around + (q[begins] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (count.astype(np.uint64) << np.uint64(32)))
    return mix(h)[q[begins]], around, first, count


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


ANCHOR_SCHEMA = "deal long, settled boolean, h long, c long, key long, mark long, start int, n int, lkey long, lmark long, lstart int"


def find_anchors(rows: DataFrame) -> DataFrame:
    """Anchor rows of key, mark, data; repeats within a batch are settled and dealt by document, the rest by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("data").to_pylist()
            keys, marks = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
            parts = []
            for a, b in _chunks(texts):
                sizes = np.array([len(t or b"") for t in texts[a:b]], np.int64)
                ends = np.cumsum(sizes)
                h, c, first, n = anchors(np.frombuffer(b"".join(t or b"" for t in texts[a:b]), np.uint8), np.repeat(ends, sizes))
                doc = np.searchsorted(ends, first, side="right")
                parts.append((h.view(np.int64), c.view(np.int64), keys[a + doc], marks[a + doc], first - (ends - sizes)[doc], n))
            h, c, key, mark, first, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 6
            order = np.lexsort((first, key, c, h))
            h, c, key, mark, first, n = (x[order] for x in (h, c, key, mark, first, n))
            # the least place leads; equal places (repeated rows) lead together
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])]) if len(h) else np.zeros(0, bool)
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else np.zeros(0, np.int64)
            settled = (key != key[lead]) | (first != first[lead])
            deal = np.where(settled, mix(key.view(np.uint64) ^ mark.view(np.uint64)).view(np.int64), h)
            for i in range(0, len(h), 50_000):
                s = slice(i, i + 50_000)
                led = [pa.array(x[lead[s]].astype(t), mask=~settled[s]) for x, t in ((key, np.int64), (mark, np.int64), (first, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(deal[s]), pa.array(settled[s]), pa.array(h[s]), pa.array(c[s]), pa.array(key[s]), pa.array(mark[s]), pa.array(first[s].astype(np.int32)), pa.array(n[s].astype(np.int32)), *led], names=["deal", "settled", "h", "c", "key", "mark", "start", "n", "lkey", "lmark", "lstart"])

    return rows.select("key", "mark", "data").mapInArrow(run, ANCHOR_SCHEMA)


def settle(anchor_rows: DataFrame) -> DataFrame:
    """key, mark, start, n and h of runs; repeat: whether a run is taken for a repeat as a whole, of the run at lkey, lmark, lstart; the bytes of the others must be compared."""
    dealt = anchor_rows.repartition("deal").sortWithinPartitions("settled", "h", "c", "key", "start")

    def places(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group begins, place of each row's leader, and whether a row repeats its leader."""
        h, c, key, start = (t.column(x).to_numpy() for x in ("h", "c", "key", "start"))
        kind = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        lead = np.maximum.accumulate(np.where(kind, np.arange(len(h)), 0))
        return np.concatenate([[True], h[1:] != h[:-1]]), lead, (key != key[lead]) | (start != start[lead])

    def decided(t: pa.Table, told: bool = False) -> Iterator[pa.RecordBatch]:
        """told: the first group is known to have several kinds, and its first row has been told."""
        group, lead, repeat = places(t)
        of_group = np.cumsum(group) - 1
        several = np.bincount(of_group, lead == np.arange(len(lead)))[of_group] > 1
        if told:
            several |= of_group == 0
        keep = repeat | several
        keep[0] &= not told
        own, led = t.select(["key", "mark", "start", "n", "h"]).filter(pa.array(keep)), lead[keep]
        out = own.append_column("repeat", pa.array(repeat[keep]))
        for c in ("key", "mark", "start"):
            x = t.column(c).to_numpy()
            out = out.append_column("l" + c, pa.array(x[led], mask=~repeat[keep]))
        yield from out.to_batches(50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, told = 0, False
        for batch in batches:
            t = pa.Table.from_batches([batch])
            done = t.filter(t.column("settled"))
            if len(done):
                done = done.append_column("repeat", pa.array(np.ones(len(done), bool)))
                yield from done.select(["key", "mark", "start", "n", "h", "repeat", "lkey", "lmark", "lstart"]).to_batches()
            t = t.filter(pa.compute.invert(t.column("settled")))
            if not len(t):
                continue
            held.append(t)
            rows += len(t)
            if rows < HELD:
                continue
            whole = pa.concat_tables(held)
            h = whole.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut:
                yield from decided(whole.slice(0, cut), told)
                held, told = [whole.slice(cut)], False
            else:  # one long group: of its rows only the leader of the last kind is still needed
                _, lead, repeat = places(whole)
                yield from decided(whole, told)
                told = told or bool(lead[-1])
                held = [whole.slice(int(lead[-1]), 1) if told else whole.filter(pa.array(~repeat))]
            rows = len(held[0])
        if rows:
            yield from decided(pa.concat_tables(held), told)

    import pyarrow.compute  # noqa: F401

    return dealt.mapInArrow(run, "key long, mark long, start int, n int, h long, repeat boolean, lkey long, lmark long, lstart int")


RANGE = "key long, mark long, start int, stop int, lkey long, lmark long, lstart int"


def repeated_ranges(repeats: DataFrame) -> DataFrame:
    """Ranges (RANGE) of bytes that repeat an earlier text in one piece: runs side by side, of one leader at one distance."""
    runs = repeats.groupBy("key", "mark").agg(F.collect_set(F.struct("lkey", "lmark", "start", "n", "lstart")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                lists = part.column("runs")
                sizes = np.array([len(x) for x in lists], np.int64)
                flat = lists.flatten()
                lkey, lmark, start, n, lstart = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lkey", "lmark", "start", "n", "lstart"))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((start, start - lstart, lmark, lkey, doc))
                doc, lkey, lmark, start, n, lstart = (x[order] for x in (doc, lkey, lmark, start, n, lstart))
                new = np.ones(len(doc), bool)
                same = [x[1:] == x[:-1] for x in (doc, lkey, lmark, start - lstart)]
                new[1:] = ~np.logical_and.reduce([*same, start[1:] == start[:-1] + n[:-1]])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(doc)) - 1
                columns = [part.column("key").to_numpy()[doc[first]], part.column("mark").to_numpy()[doc[first]], start[first].astype(np.int32), (start[last] + n[last] + LENGTH - 1).astype(np.int32), lkey[first], lmark[first], lstart[first].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "mark", "start", "stop", "lkey", "lmark", "lstart"])

    return runs.mapInArrow(run, RANGE)


def with_proof(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """ranges with `proved`: whether their bytes and those of the leader have one SHA-256. rows: key, mark, data, bucketed by key and mark.

    Equal spans of leaders are read once, and a span that many ranges repeat is looked up by broadcast.
    """
    n = F.col("stop") - F.col("start")
    spans = ranges.select("lkey", "lmark", "lstart", n.alias("n")).distinct()
    digest = lambda start: F.sha2(F.substring(F.col("data"), F.col(start) + 1, F.col("n")), 256)
    span = F.concat_ws(":", "lkey", "lmark", "lstart", "n")
    texts = rows.toDF("lkey", "lmark", "data").join(spans.hint("shuffle_hash"), ["lkey", "lmark"])
    # equal rows have equal bytes
    leaders = written(texts.select(span.alias("span"), digest("lstart").alias("led")).distinct(), "leader-spans")
    own = rows.join(ranges.withColumn("n", n).hint("shuffle_hash"), ["key", "mark"]).select("key", "mark", "start", "stop", span.alias("span"), digest("start").alias("own")).distinct()
    own = written(own, "repeated-spans")
    return looked_up(own, "span", leaders, own.count()).select("key", "mark", "start", "stop", F.coalesce(F.col("own") == F.col("led"), F.lit(False)).alias("proved"))


def compare(contexts: DataFrame) -> DataFrame:
    """Ranges (start, stop) of bytes in windows that start earlier as well; contexts: h, key, mark, start, n, bytes."""
    rows = contexts.repartition("h").sortWithinPartitions("h")

    def decided(rows: list[dict]) -> pa.RecordBatch | None:
        texts = [r["bytes"] for r in rows]
        first, starts, counts = (np.array([r[c] for r in rows], np.int64) for c in ("key", "start", "n"))
        repeated = repeated_windows(texts, first, starts, counts)
        owner = np.repeat(np.arange(len(rows)), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
        w = np.flatnonzero(repeated)
        if not len(w):
            return None
        begins = np.flatnonzero(np.concatenate([[True], (owner[w][1:] != owner[w][:-1]) | (place[w][1:] != place[w][:-1] + 1)]))
        stops = np.append(begins[1:], len(w)) - 1
        own = owner[w[begins]]
        return pa.RecordBatch.from_arrays(
            [pa.array(first[own]), pa.array(np.array([r["mark"] for r in rows], np.int64)[own]), pa.array(place[w[begins]].astype(np.int32)), pa.array((place[w[stops]] + LENGTH).astype(np.int32))],
            names=["key", "mark", "start", "stop"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for r in batch.to_pylist():
                group = r["h"]
                if size >= BLOCK_BYTES and group != last:
                    out = decided(block)
                    if out is not None:
                        yield out
                    block, size = [], 0
                last = group
                block.append(r)
                size += len(r["bytes"])
        if block and (out := decided(block)) is not None:
            yield out

    return rows.mapInArrow(run, "key long, mark long, start int, stop int")


def dealt_windows(contexts: DataFrame) -> DataFrame:
    """The same as compare(), for anchors of any number of kinds: each window by itself, told by its digest."""
    at = contexts.select("key", "mark", "start", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    digest = F.unhex(F.md5(F.substring(F.col("bytes"), F.col("k") + 1, F.lit(LENGTH))))
    windows = written(at.select("key", "mark", (F.col("start") + F.col("k")).alias("start"), digest.alias("window")), "windows")
    least = windows.groupBy("window").agg(F.min(F.struct("key", "start")).alias("least"), F.count("*").alias("n")).where("n > 1")
    least = written(least, "least-windows")
    met = looked_up(windows, "window", least.select("window", "least"), hot=least.where(F.col("n") > HOT).select("window"))
    return met.where(F.struct("key", "start") > F.col("least")).select("key", "mark", "start", (F.col("start") + LENGTH).alias("stop"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the ranges of bytes (array of struct<start, stop>, may overlap) that start earlier, under a name that fresh() finds for "ranges"."""
    columns, made = docs.columns, fresh(docs.columns, "ranges")
    key, mark = fresh(columns, "_key"), fresh(columns, "_mark")
    marked = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)), mark: F.xxhash64(F.coalesce("text", F.lit("")))})
    stored = bucketed(marked, key, mark)
    rows = stored.select(F.col(key).alias("key"), F.col(mark).alias("mark"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    found = written(settle(find_anchors(rows)), "anchors")
    proof = written(with_proof(written(repeated_ranges(found.where("repeat")), "ranges"), rows), "proved-ranges")
    asked, whole = found.where("not repeat").select("key", "mark", "start", "n", "h"), proof.where("proved").select("key", "mark", "start", "stop")
    wrong = proof.where("not proved")
    if not wrong.isEmpty():
        # two different surroundings with one hash: all rows of such anchors, with the leaders, are compared
        hit = found.where("repeat").alias("a").join(wrong.alias("w"), (F.col("a.key") == F.col("w.key")) & (F.col("a.mark") == F.col("w.mark")) & (F.col("a.start") >= F.col("w.start")) & (F.col("a.start") < F.col("w.stop")), "left_semi")
        again = found.join(hit.select("h").distinct(), "h", "left_semi")
        led = again.where("repeat").select(F.col("lkey").alias("key"), F.col("lmark").alias("mark"), F.col("lstart").alias("start"), "n", "h")
        asked = asked.unionByName(again.select(asked.columns)).unionByName(led).distinct()
    # at most one busy anchor for GROUP rows
    busy = written(asked.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("h", F.lit(True).alias("busy")), "busy-anchors")
    several = busy.count()
    asked = asked.join(F.broadcast(busy) if several <= BROADCAST_ROWS else busy, "h", "left").withColumn("busy", F.col("busy").isNotNull())
    by_text = asked.groupBy("key", "mark").agg(F.collect_set(F.struct("h", "busy", "start", "n")).alias("asked"))
    # equal rows stand once
    once = rows.join(by_text.hint("shuffle_hash"), ["key", "mark"]).dropDuplicates(["key", "mark"])
    contexts = once.select("key", "mark", "data", F.explode("asked").alias("a")).select(
        "key", "mark", F.col("a.h").alias("h"), F.col("a.busy").alias("busy"), F.col("a.start").alias("start"), F.col("a.n").alias("n"),
        F.substring(F.col("data"), F.col("a.start") + 1, F.col("a.n") + (LENGTH - 1)).alias("bytes"),
    )
    # a leader stands with the number of windows of the run that was taken for it
    contexts = contexts.withColumn("n", F.least("n", F.octet_length("bytes") - (LENGTH - 1))).where("n > 0")
    if several:
        contexts = written(contexts, "contexts")
        whole = whole.unionByName(dealt_windows(contexts.where("busy")))
        contexts = contexts.where("not busy")
    ranges = whole.unionByName(compare(contexts.drop("busy"))).groupBy("key", "mark").agg(F.collect_set(F.struct("start", "stop")).alias(made))
    ranges = ranges.select(F.col("key").alias(key), F.col("mark").alias(mark), made)
    return stored.join(ranges.hint("shuffle_hash"), [key, mark], "left").select(*(F.col(f"`{c}`") for c in columns), made)


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of ranges."""
    out: list[tuple[int, int]] = []
    for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
        if out and r[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
        else:
            out.append(r)
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]) if runs else data


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, sha = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data, runs = (text or "").encode("utf-8", "surrogatepass"), merged(ranges)
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in runs))
                spans.append(len(runs))
                sha.append(hashlib.sha256(kept_bytes(data, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = remove_repeats(docs.select("doc_id", "text"))
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of `text`; a character that is cut in two is dropped as a whole. n_chars follows."""
    found, made = remove_repeats(docs), fresh(docs.columns, "ranges")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for text, rs in zip(texts, ranges, strict=True):
            runs = merged([] if rs is None else [r if isinstance(r, dict) else r.asDict() for r in rs])
            out.append(text if text is None or not runs else kept_bytes(text.encode(), runs).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    out = found.withColumn("text", F.when(F.col(made).isNull(), F.col("text")).otherwise(cut("text", made)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(made).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
