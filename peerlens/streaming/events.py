"""Structured Streaming over event tables: windows, duplicates within a watermark, and lifecycle state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, watermark: str = "1 day", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events and their value in tumbling or sliding windows; batch or stream."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "value")


def sessions(events: DataFrame, gap: str, key: str = "user_id", watermark: str = "1 day") -> DataFrame:
    """Sessions of a key: they end after a gap without events."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def without_repeats(events: DataFrame, keys: list[str], watermark: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


#: Before every event.
NEVER = -(1 << 63)
STATE = "registered boolean, snapshots int, other_ts long, other_id long, error_ts array<long>, error_id array<long>"
LIFECYCLE = "user_id long, status string, snapshots int, errors int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A user's rows come in any order and in several frames. The state keeps the last event that is no error, and the errors behind it."""
    registered, snapshots, *last, stamps, ids = state.get if state.exists else (False, 0, NEVER, NEVER, [], [])
    last, errors = tuple(last), list(zip(stamps, ids, strict=True))
    for frame in batches:
        kind, at = frame["event_type"], frame["ts"].astype("datetime64[us]").astype("int64")
        registered = registered or bool((kind == "signup").any())
        snapshots += int(kind.isin(["signup", "purchase"]).sum())
        is_error = kind == "error"
        errors.extend(zip(at[is_error].tolist(), frame["event_id"][is_error].tolist(), strict=True))
        last = max([last, *zip(at[~is_error].tolist(), frame["event_id"][~is_error].tolist(), strict=True)])
        errors = [e for e in errors if e > last]
    state.update((bool(registered), int(snapshots), *last, [t for t, _ in errors], [i for _, i in errors]))
    status = "silent" if registered and len(errors) >= 2 else "active" if registered else "prospect"
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "snapshots": [int(snapshots)], "errors": [len(errors)]})


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """State of each user after each batch: signup registers, signup and purchase are snapshots, errors in a row silence; in the order of ts and event_id, whatever the order they come in."""
    return events.groupBy("user_id").applyInPandasWithState(_advance, LIFECYCLE, STATE, "update", GroupStateTimeout.NoTimeout)
