"""Streaming forms give the rows of the batch forms on a finite input."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.operators import events as batch
from tallymark.plans import stream_queries
from tallymark.plans.stream_queries import _finished, _staged
from tallymark.specs import Rule
from tallymark.streaming import events as live

SCHEMA = "event_id long, ts timestamp, k string, path string, value double, priority int, change int"
FLUSH = 10**9


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Six files of events in time order; the last one only moves the watermark."""
    rng = random.Random(5)
    rows, t = [], dt.datetime(2024, 1, 1)
    for i in range(600):
        t += dt.timedelta(milliseconds=rng.randrange(0, 4000))
        rows.append((i, t, rng.choice("aaab"), rng.choice("pqr"), float(i % 7), i % 4, rng.choice([1, 1, -1])))
    folder = str(tmp_path_factory.mktemp("feed"))
    for n in range(5):
        part = rows[n * 120 : (n + 1) * 120]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    far = t + dt.timedelta(days=1)
    marks = [(FLUSH + i, far + dt.timedelta(days=i), "zz", "z", 0.0, 0, 0) for i in range(3)]
    for i, mark in enumerate(marks):
        spark.createDataFrame([mark], SCHEMA).coalesce(1).write.parquet(f"{folder}/{5 + i}")
    events = spark.createDataFrame(rows, SCHEMA)
    return folder, events


def stream_of(spark, folder):
    return (
        spark.readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .option("latestFirst", False)
        .parquet(folder)
    )


def drain(spark, df, name, tmp_path):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).start()
    )
    try:
        query.processAllAvailable()
        return spark.table(name), live.late_rows(query)
    finally:
        query.stop()


def ids(df):
    return {r.event_id for r in df.select("event_id").collect() if r.event_id < FLUSH}


def test_dedup_window(spark, feed, tmp_path):
    folder, events = feed
    want = ids(batch.dedup_window(events, F.col("k"), "ts", "event_id", 20))
    out, late = drain(spark, live.dedup_window(stream_of(spark, folder), F.col("k"), "ts", "event_id", 20), "dedup", tmp_path)
    assert late == 0
    assert ids(out) == want


def test_token_bucket(spark, feed, tmp_path):
    folder, events = feed
    want = ids(batch.token_bucket(events, F.col("k"), "ts", "event_id", 6_000_000, 3).where("accepted"))
    out, _ = drain(spark, live.token_bucket(stream_of(spark, folder), F.col("k"), "ts", "event_id", 6_000_000, 3), "bucket", tmp_path)
    assert ids(out.where("accepted")) == want
    assert ids(out) == set(range(600))


def test_admission(spark, feed, tmp_path):
    folder, events = feed
    want = batch.admission(events, "k", "ts", "event_id", "change", "priority", critical=20, reject=40)
    out, _ = drain(
        spark,
        live.admission(stream_of(spark, folder), F.col("k"), "ts", "event_id", F.col("change"), F.col("priority"), critical=20, reject=40),
        "admission", tmp_path,
    )
    cols = ["event_id", "depth", "effective_priority", "result", "pressure"]
    assert sorted(map(tuple, out.select(*cols).where(F.col("event_id") < FLUSH).collect())) == sorted(
        map(tuple, want.select(*cols).collect())
    )


def test_debounce(spark, feed, tmp_path):
    folder, events = feed
    want = batch.debounce(events, "k", "ts", "event_id", "path", 5).select("k", "first_event", "flush_at", "events", "paths")
    out, _ = drain(spark, live.debounce(stream_of(spark, folder), "k", "ts", "path"), "debounce", tmp_path)
    got = out.where("k != 'zz'").select("k", "first_event", "flush_at", "events", "paths")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tumbling_and_sliding(spark, feed, tmp_path):
    folder, events = feed
    for name, stream, want in (
        ("tumbling", live.tumbling_metrics(stream_of(spark, folder), "ts", "1 minute", ["k"]), batch.tumbling_metrics(events, "ts", "1 minute", ["k"])),
        ("sliding", live.sliding_metrics(stream_of(spark, folder), "ts", "2 minutes", "1 minute", ["k"]), batch.sliding_metrics(events, "ts", "2 minutes", "1 minute", ["k"])),
    ):
        out, _ = drain(spark, stream, name, tmp_path)
        assert sorted(map(tuple, out.where("k != 'zz'").collect())) == sorted(map(tuple, want.collect()))


def test_burst_windows(spark, feed, tmp_path):
    folder, events = feed
    want = batch.burst_windows(events, "ts", "1 minute", 20, ["k"])
    out, _ = drain(spark, live.burst_windows(stream_of(spark, folder), "ts", "1 minute", 20, ["k"]), "burst", tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_stale_slots(spark, feed, tmp_path):
    folder, events = feed
    acquired = stream_of(spark, folder)
    released = stream_of(spark, folder).where("event_id % 3 != 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 SECONDS"))
    out, _ = drain(spark, live.stale_slots(acquired, released, "event_id", "ts", "1 minute"), "slots", tmp_path)
    assert ids(out) == {i for i in range(600) if i % 3 == 0}


def test_open_slots_of_the_last_minute_come_out(spark):
    """The end of a bounded stream releases the state of the outer join, on both sides."""
    start = dt.datetime(2024, 1, 1)
    taken = [(i, start + dt.timedelta(minutes=i)) for i in range(100)]
    given = [(i, t + dt.timedelta(seconds=20)) for i, t in taken if i % 10 and i < 99]
    schema = "slot_id long, ts timestamp"
    (acquired, one), (released, two) = (_staged(spark.createDataFrame(rows, schema), key="slot_id") for rows in (taken, given))
    done = _finished(live.stale_slots(acquired, released, "slot_id", "ts", "1 hour"), one, two)
    assert {r.slot_id for r in done.collect() if r.slot_id >= 0} == {*range(0, 100, 10), 99}


def test_a_hot_key_is_stored_by_slices_and_released(spark, tmp_path):
    """Chunks of a key lie apart in the state store, and nothing is left at the end."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(milliseconds=7 * i), "hot") for i in range(30_000)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, k string")
    stream, feed = _staged(events)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in feed:
        done = live.run_available(live.dedup_window(stream, F.col("k"), "ts", "event_id", 3), path, checkpoint)
    assert ids(done.where("event_id is not null")) == ids(batch.dedup_window(events, F.col("k"), "ts", "event_id", 3))
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load()
    assert state.where("key.k = 'hot'").count() == 0


def test_late_rows_are_counted(spark, tmp_path):
    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    folder = tmp_path / "late_feed"
    for n, (i, t) in enumerate([(0, late), (1, late + dt.timedelta(hours=1)), (2, early)]):
        spark.createDataFrame([(i, t, "a", "p", 1.0, 0, 1)], SCHEMA).coalesce(1).write.parquet(f"{folder}/{n}")
    _, dropped = drain(spark, live.tumbling_metrics(stream_of(spark, str(folder)), "ts"), "late", tmp_path)
    assert dropped == 1


def test_findings_sink_is_repeatable(spark, feed, tmp_path):
    folder, _ = feed
    rules = [Rule("small", "value", "range", maximum=5)]
    for checkpoint in ("cp1", "cp2"):
        query = live.findings_sink(stream_of(spark, folder), rules, str(tmp_path / "out"), str(tmp_path / checkpoint))
        query.awaitTermination(120)
        query.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    bad, good = out.where("verdict = 'bad'"), out.where("verdict = 'good'")
    assert bad.count() == len([i for i in range(600) if i % 7 > 5])
    assert good.count() + bad.count() == 603
    assert [r.broken_rules for r in bad.limit(1).collect()] == [["small"]]


def test_approximate_dedup_keeps_a_subset(spark, feed, tmp_path):
    folder, _ = feed
    out, _ = drain(spark, live.dedup_approximate(stream_of(spark, folder), ["k"], "ts", "20 seconds"), "approx", tmp_path)
    assert 2 <= out.count() <= 600


def test_staged_rows_of_many_unordered_partitions_are_not_late(spark, tmp_path):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=rng.randrange(86_400)), rng.choice("ab"), 1.0) for i in range(3000)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").repartition(24)
    stream, feed = _staged(events)
    hours, path, checkpoint, late = live.tumbling_metrics(stream, "ts", "1 hour", ["event_type"]), str(tmp_path / "out"), str(tmp_path / "check"), 0
    for _ in feed:
        query = hours.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        late += live.late_rows(query)
    assert late == 0
    assert spark.read.parquet(path).where("event_type is not null").agg(F.sum("n")).first()[0] == 3000


def test_staged_rows_without_a_time_reach_the_stream(spark):
    rows = [(1, None), (2, dt.datetime(2024, 1, 1)), (3, dt.datetime(2024, 1, 2))]
    stream, feed = _staged(spark.createDataFrame(rows, "event_id long, ts timestamp"))
    assert ids(_finished(stream, feed).where("event_id is not null")) == {1, 2, 3}
    timed = spark.createDataFrame([(i, t, "a") for i, t in rows], "event_id long, ts timestamp, k string")
    stream, feed = _staged(timed)
    done = _finished(live.dedup_window(stream, F.col("k"), "ts", "event_id", 3600), feed)
    assert ids(done.where("event_id is not null")) == {2, 3}


class _Store:
    """What a bucket keeps, with a count of the calls."""

    def __init__(self):
        self.value, self.rows, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def keys(self):
        self.calls += 1
        return iter(list(self.rows))

    def getValue(self, key):
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_calls_to_the_state_store_grow_with_blocks_and_not_with_events():
    rng = random.Random(3)
    rows = [(rng.randrange(10**12), i, 0, 0, 1, str(rng.randrange(500))) for i in range(20_000)]

    def decide(number, ready):
        assert ready == sorted(ready, key=lambda e: e[:2])
        return max(number, ready[-1][0]), {"event_id": [e[1] for e in ready], "accepted": [e[0] > number for e in ready]}

    store = _Store()
    walk = live._Walk(decide, lambda number: number, ["k", "event_id", "accepted"], run_rows=6000, block_rows=2000)
    walk.init(store)
    columns = ["t", "id", "change", "level", "known", "name"]
    frames = [pd.DataFrame(rows[i : i + 1000], columns=columns) for i in range(0, len(rows), 1000)]
    assert not list(walk.handleInputRows(("b",), iter(frames), store))
    out = []
    for store.watermark in (4 * 10**8, 2 * 10**9):
        out += walk.handleExpiredTimer(("b",), store, None)
    given = pd.concat(out)
    assert sorted(given["event_id"]) == list(range(20_000)) and given["accepted"].all()
    assert dict(zip(given["event_id"], given["k"], strict=True)) == {r[1]: r[5] for r in rows}
    assert not store.rows and store.value is None
    assert store.calls < 80


def test_the_debounce_query_keeps_no_sketch_and_no_state_in_the_heap(spark, monkeypatch):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    seen = []
    monkeypatch.setattr(stream_queries.live, "run_available", lambda stream, *_: seen.append(stream) or spark.range(0).selectExpr("timestamp '2024-01-01' AS first_event", "timestamp '2024-01-01' AS flush_at"))
    stream_queries.stream_debounce(spark, "/root/testdata/sf0.001")
    assert "paths" not in seen[0].columns
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
