"""Follow-ups by timers against the same rules over whole lists of events."""

import random

from pyspark.sql import functions as F

from peerlens.streaming import followups

OFFSETS, GRACE = [1, 3, 5], 2


def plain(events, now):
    """(company, time, event, offset) of all events up to `now`, from lists."""
    out = []
    for c in {e[0] for e in events}:
        own = [(t, k) for x, k, t in events if x == c]
        registered = [t for t, k in own if k == "registered"]
        if not registered:
            continue
        missed = []
        for o in OFFSETS:
            due = min(registered) + o * followups.DAY
            end = due + GRACE * followups.DAY
            out.append((c, due, "due", o))
            if not any(k == "answered" and due < t <= end for t, k in own):
                missed.append((end, o))
                out.append((c, end, "missed", o))
        for n, (end, o) in enumerate(sorted(missed), 1):
            last = max(((t, k == "dead") for t, k in own if k in ("alive", "dead") and t <= end), default=(0, False))
            if n >= 2 and last[1]:
                out.append((c, end, "silent", o))
                break
    return sorted(e for e in out if e[1] <= now)


def test_timers_equal_lists_over_several_batches(spark, tmp_path):
    rng, start = random.Random(5), 1_704_067_200_000
    events = [(c, kind, start + rng.randrange(9 * followups.DAY)) for c in range(25) for kind in ["registered"] * (c % 5 > 0) + rng.choices(["answered", "alive", "dead", "noise"], k=8)]
    events += [(99, "noise", start + 40 * followups.DAY)]
    events.sort(key=lambda e: e[2])
    parts = [events[:90], events[90:]]
    for i, part in enumerate(parts):  # the files of two batches
        df = spark.createDataFrame(part, "company_id long, kind string, at long").select("company_id", "kind", F.timestamp_millis("at").alias("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = followups.run(followups.follow_ups(stream, OFFSETS, GRACE)).select("company_id", F.unix_millis("at").alias("at"), "event", "offset").collect()
    want = plain(events, start + 39 * followups.DAY)
    assert sorted(map(tuple, got)) == want and {e[2] for e in want} == {"due", "missed", "silent"}


def test_no_timer_before_its_time(spark, tmp_path):
    spark.createDataFrame([(1, "registered", 1_704_067_200_000), (2, "noise", 1_704_067_200_000 + 2 * followups.DAY)], "company_id long, kind string, at long").select("company_id", "kind", F.timestamp_millis("at").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = followups.run(followups.follow_ups(stream, [0, 3], 2, watermark="1 hour")).collect()
    assert [(r.company_id, r.event, r.offset) for r in got] == [(1, "due", 0)]
