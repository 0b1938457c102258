"""Follow-ups over a stream of events, driven by timers of event time.

A company's first registration sets a timer for each follow-up and one for the end of its time of grace. When the watermark passes them, the follow-up is
`due`; it is `missed` if no answer came after it was due and within the grace; and the company is `silent` from the first missed follow-up at
which it has missed enough of them and its last probe until then found no site. State is what a company has said: its registration, answers and
probes. Events later than the watermark are dropped by Spark; a registration that comes after another one changes nothing.

Needs the RocksDB state store (see run()) and the time zone that the events' timestamps are in.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from peerlens.functions import lexicons as lx
from peerlens.sources.sinks import scratch

DAY = 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "registered bigint, answers array<bigint>, probes array<bigint>, dead array<boolean>"
OUT = "company_id bigint, at bigint, event string, offset int"


def told_at(at: int, registered: int, answers: list[int], probes: list[tuple[int, bool]], offsets: list[int], grace: int, misses: int) -> list[tuple[str, int]]:
    """(event, offset in days) of what happens to a company at a time in milliseconds."""
    due = {o: registered + o * DAY for o in offsets}
    ends = {o: d + grace * DAY for o, d in due.items()}
    missed = {o for o, d in due.items() if not any(d < a <= ends[o] for a in answers)}

    def silent(t: int) -> bool:
        last = max((p for p in probes if p[0] <= t), default=None)
        return sum(ends[o] <= t for o in missed) >= misses and last is not None and last[1]

    out = [("due", o) for o in offsets if due[o] == at]
    ended = [o for o in offsets if ends[o] == at and o in missed]
    out += [("missed", o) for o in ended]
    if ended and silent(at) and not any(silent(ends[o]) for o in missed if ends[o] < at):
        out.append(("silent", ended[0]))
    return out


class FollowUps(StatefulProcessor):
    """Rows (company_id, kind, at): kinds registered, answered, alive and dead; others are passed over."""

    def __init__(self, offsets: list[int], grace: int, misses: int):
        self.offsets, self.grace, self.misses = offsets, grace, misses

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("company", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        registered, answers, probes, dead = self.state.get() if self.state.exists() else (None, [], [], [])
        answers, found = list(answers or []), list(zip(probes or [], dead or []))
        first = []
        for r in rows:
            match r["kind"]:
                case "registered":
                    first.append(r["at"])
                case "answered":
                    answers.append(r["at"])
                case "alive" | "dead":
                    found.append((r["at"], r["kind"] == "dead"))
        if registered is None and first:
            registered = min(first)
            for o in self.offsets:
                self.handle.registerTimer(registered + o * DAY)
                self.handle.registerTimer(registered + (o + self.grace) * DAY)
        self.state.update((registered, answers, [p for p, _ in found], [d for _, d in found]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        registered, answers, probes, dead = self.state.get()
        for event, offset in told_at(at, registered, list(answers), list(zip(probes, dead)), self.offsets, self.grace, self.misses):
            yield Row(company_id=key[0], at=at, event=event, offset=offset)

    def close(self) -> None:
        pass


def follow_ups(events: DataFrame, offsets: list[int] | None = None, grace: int = 31, misses: int = 2, watermark: str = "1 day") -> DataFrame:
    """company_id, at, event, offset from a stream of events (company_id, kind, ts)."""
    rows = events.withWatermark("ts", watermark).select(F.col("company_id").cast("long").alias("company_id"), "kind", F.unix_millis("ts").alias("at"), "ts")
    made = rows.groupBy("company_id").transformWithState(FollowUps(offsets or lx.FOLLOWUP_DAYS, grace, misses), OUT, "append", "EventTime")
    return made.select("company_id", F.timestamp_millis("at").alias("at"), "event", "offset")


def run(made: DataFrame, name: str = "follow-ups") -> DataFrame:
    """Runs a stream over all that is there now, with its state in RocksDB, and gives what it wrote; a run that is stopped goes on from its checkpoint."""
    spark, path = made.sparkSession, scratch(made.sparkSession, name)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(made.schema).parquet(f"{path}/out")
