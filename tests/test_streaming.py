from pyspark.sql import functions as F

from peerlens.streaming import events as ev

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows(spark):
    data = [(1, "2024-01-01 00:00:00", 1, "signup", 1.0), (2, "2024-01-01 00:10:00", 1, "error", 0.0), (3, "2024-01-01 00:20:00", 1, "error", 0.0), (4, "2024-01-02 05:00:00", 2, "view", 2.0), (4, "2024-01-02 05:00:00", 2, "view", 2.0)]
    return spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e"))
    batch = sorted(map(tuple, ev.windowed_counts(spark.read.parquet(str(tmp_path / "e")), "1 hour").collect()))
    assert sorted(map(tuple, run(spark, ev.windowed_counts(stream, "1 hour"), "w", "complete"))) == batch
    got = run(spark, ev.without_repeats(stream, ["event_id"]), "d", "append")
    assert sorted(r.event_id for r in got) == [1, 2, 3, 4]
    state = {r.user_id: (r.status, r.snapshots, r.errors) for r in run(spark, ev.lifecycle_stream(stream), "s", "update")}
    assert state == {1: ("silent", 1, 2), 2: ("prospect", 0, 0)}


def test_sessions(spark):
    got = sorted((r.user_id, r.n) for r in ev.sessions(rows(spark), "15 minutes").collect())
    assert got == [(1, 3), (2, 2)]


def test_lifecycle_of_rows_in_any_order():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rows = pd.DataFrame({"event_id": range(6), "ts": pd.to_datetime([f"2024-01-01 00:0{i}:00" for i in range(6)]), "event_type": ["signup", "error", "view", "error", "error", "error"]})
    for order in ([5, 2, 0, 3, 1, 4], [1, 3, 4, 5, 0, 2], [2, 1, 0, 5, 4, 3]):
        state = State()
        frames = [rows.iloc[order[a : a + 2]] for a in (0, 2, 4)]
        (first,) = ev._advance((7,), iter(frames[:2]), state)
        (last,) = ev._advance((7,), iter(frames[2:]), state)
        assert last.values.tolist() == [[7, "silent", 1, 3]]
