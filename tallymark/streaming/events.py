"""Structured Streaming forms of the event-time operators.

They share the decision rule with the batch forms and give the same rows on
the same input, except for late rows: the watermark drops those, and
``late_rows`` tells how many. Event times without zone are read in the session
zone, which has to be UTC to agree with the batch forms.

Stateful keys keep one number plus the events that the watermark has not
passed yet, in sorted blocks in the state store that many keys share, and nothing once the number
no longer matters. All forms work in append mode, so state is released as the
watermark moves. ``burst_batches`` keeps no state
and works on streams as it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallymark.functions.scalars import pressure_level
from tallymark.operators.events import NEVER, pass_count
from tallymark.operators.quality import broken
from tallymark.operators.shape import exact_sum
from tallymark.specs import Rule

#: Groups into which keys fall; a checkpoint holds for one number only.
BUCKETS = 128
#: Waiting events of a bucket that are sorted together, and that one row of the state store holds at most.
RUN_ROWS, BLOCK_ROWS = 1 << 18, 1 << 13
#: Output columns of whole numbers, which may be missing.
_WHOLE = {"event_id", "depth", "priority"}
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(stream: DataFrame, moment: str, delay: str) -> DataFrame:
    """Event time as a zoned timestamp with a watermark; what waits for it is kept in RocksDB, not in the heap."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return stream.withColumn(moment, F.col(f"`{moment}`").cast("timestamp")).withWatermark(moment, delay)


class _Walk(StatefulProcessor):
    """Walks the events of each key in (time, id) order behind the watermark, for the keys of one bucket together.

    Waiting events lie in a map from (first time, serial) to packed columns: what
    a batch brings to a bucket is sorted in runs and cut into blocks of bounded
    size, so the calls to the state store grow with the blocks and neither with
    the events nor with the keys, and no state row holds the events of a key in
    a list. A timer just behind the first waiting event merges the blocks that
    the watermark has reached; only blocks that overlap in time are held together.
    """

    def __init__(self, decide, needed, columns: list[str], run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS):
        self._decide, self._needed, self._columns = decide, needed, columns
        self._run_rows, self._block_rows = run_rows, block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._numbers = handle.getValueState("numbers", "keys string, packed binary, serial long")
        self._waiting = handle.getMapState("waiting", "first long, serial long", "keys string, packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begin, first, run, held = None, None, [], 0
        for pdf in rows:
            if pdf.empty:
                continue
            if begin is None:
                begin = self._numbers.get() or ("[]", b"", 0)
                serial = begin[2]
            run.append(pdf)
            held += len(pdf)
            if held >= self._run_rows:
                first, serial = self._wait(*_coded(run), first, serial)
                run, held = [], 0
        if run:
            first, serial = self._wait(*_coded(run), first, serial)
        if first is not None:
            self._numbers.update((begin[0], bytes(begin[1]), serial))
            self._handle.registerTimer(first // 1000 + 1)
        return iter(())

    def _wait(self, keys: list, events: np.ndarray, first: int | None, serial: int) -> tuple[int, int]:
        """Store a run of events; returns the first time of all and the next serial number."""
        events = in_order([events])
        for i in range(0, len(events), self._block_rows):
            block = events[i : i + self._block_rows].copy()
            used, block[:, 5] = np.unique(block[:, 5], return_inverse=True)
            self._waiting.updateValue((int(block[0, 0]), serial), (json.dumps([keys[c] for c in used]), block.tobytes()))
            serial += 1
        begin = int(events[0, 0])
        return (begin if first is None else min(first, begin)), serial

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        names, packed, serial = self._numbers.get() or ("[]", b"", 0)
        keys = json.loads(names)
        codes = {k: c for c, k in enumerate(keys)}
        numbers = dict(enumerate(np.frombuffer(bytes(packed), dtype=np.int64).tolist()))
        # Keys only; the events are read block by block.
        stored = sorted((k[0], k[1]) for k in self._waiting.keys())
        reached = [k for k in stored if k[0] < watermark]
        events = np.empty((0, 6), dtype=np.int64)
        for first, blocks in groupby(reached, key=lambda k: k[0]):
            events, out = self._ended(keys, numbers, events, first)
            yield from out
            read = [events]
            for block in blocks:
                names, packed = self._waiting.getValue(block)
                part = np.frombuffer(bytes(packed), dtype=np.int64).reshape(-1, 6).copy()
                for k in (own := json.loads(names)):
                    if k not in codes:
                        codes[k] = len(keys)
                        keys.append(k)
                part[:, 5] = np.array([codes[k] for k in own])[part[:, 5]]
                read.append(part)
                self._waiting.removeKey(block)
            events = in_order(read)
        events, out = self._ended(keys, numbers, events, watermark)
        yield from out
        waits = stored[len(reached)][0] if len(reached) < len(stored) else None
        if len(events):
            waits, serial = self._wait(keys, events, waits, serial)
        lasts = {c: self._needed(n) for c, n in numbers.items()}
        kept = [c for c, last in lasts.items() if last is None or last > watermark]
        if waits is None and not kept:
            self._numbers.clear()
            return
        self._numbers.update((json.dumps([keys[c] for c in kept]), np.array([numbers[c] for c in kept], dtype=np.int64).tobytes(), serial))
        ends = [lasts[c] for c in kept if lasts[c] is not None]
        if waits is not None:
            self._handle.registerTimer(waits // 1000 + 1)
        elif ends:
            self._handle.registerTimer(max(ends) // 1000 + 1)

    def _ended(self, keys: list, numbers: dict, events: np.ndarray, border: int) -> tuple[np.ndarray, list[pd.DataFrame]]:
        """Decide the events before ``border``; returns the events that are left and the output."""
        ends = int(np.searchsorted(events[:, 0], border))
        if not ends:
            return events, []
        ready = events[:ends][np.argsort(events[:ends, 5], kind="stable")]
        begin = np.flatnonzero(np.diff(ready[:, 5], prepend=-1)).tolist()
        of, given = [], {c: [] for c in self._columns[1:]}
        for a, b in zip(begin, [*begin[1:], len(ready)], strict=True):
            code = int(ready[a, 5])
            some = [(t, i if k & 1 else None, c, v if k & 2 else None) for t, i, c, v, k, _ in ready[a:b].tolist()]
            numbers[code], out = self._decide(numbers.get(code, NEVER), some)
            of += [keys[code]] * len(out["event_id"])
            for c, column in given.items():
                column += out[c]
        if not of:
            return events[ends:], []
        columns = {c: pd.array(v, dtype="Int64") if c in _WHOLE else v for c, v in given.items()}
        return events[ends:], [pd.DataFrame({"k": of, **columns})[self._columns]]

    def close(self) -> None:
        pass


def _coded(run: Sequence[pd.DataFrame]) -> tuple[list, np.ndarray]:
    """Keys, and the columns of a run's events with the number of the key as the last."""
    pdf = run[0] if len(run) == 1 else pd.concat(run, ignore_index=True)
    codes, keys = pd.factorize(pdf["name"].astype(object), use_na_sentinel=False)
    events = np.column_stack([pdf[["t", "id", "change", "level", "known"]].to_numpy(dtype=np.int64), codes])
    return [None if pd.isna(k) else k for k in keys], events


def in_order(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Events in order of time and id; a missing id comes first."""
    events = parts[0] if len(parts) == 1 else np.concatenate(parts)
    return events[np.lexsort((events[:, 1], events[:, 4] & 1, events[:, 0]))]


def _stateful(
    stream: DataFrame, key: Column, moment: str, event_id: str, delay: str, decide, result: str, change: Column, level: Column, needed
) -> DataFrame:
    """Run ``decide(number, ready events) -> (number, output columns)`` per key in event-time order.

    ``needed(number)`` is the time (microseconds) up to which a key without
    waiting events must be remembered, or None if it must be for good. State is
    kept in RocksDB, so it may exceed the memory of an executor. Keys share
    ``BUCKETS`` groups, because Python reaches the state of a group by calls
    that cost milliseconds each.
    """
    slim = with_event_time(stream, moment, delay).select(
        F.pmod(F.xxhash64(key.cast("string")), F.lit(BUCKETS)).cast("string").alias("k"),
        key.cast("string").alias("name"),
        F.col(f"`{moment}`").alias("moment"),
        F.unix_micros(F.col(f"`{moment}`")).alias("t"),
        F.coalesce(F.col(f"`{event_id}`").cast("long"), F.lit(0)).alias("id"),
        F.coalesce(change.cast("long"), F.lit(0)).alias("change"),
        F.coalesce(level.cast("long"), F.lit(0)).alias("level"),
        # Columns with nulls would reach Python as floating point: bit 0 tells an id, bit 1 a level.
        (F.col(f"`{event_id}`").isNotNull().cast("long") + level.isNotNull().cast("long") * 2).alias("known"),
    ).where(F.col("t").isNotNull())  # without a time there is no order
    columns = ["k", *[c.split()[0] for c in result.split(", ")]]
    return slim.groupBy("k").transformWithStateInPandas(
        _Walk(decide, needed, columns), f"k string, {result}", "append", "EventTime"
    )


def token_bucket(stream: DataFrame, key: Column, moment: str, event_id: str, interval_us: int, burst: int, delay: str = "1 minute") -> DataFrame:
    """``k, event_id, accepted`` of every event once the watermark has passed it."""

    def decide(free: int, ready: list) -> tuple[int, dict]:
        ids, accepted = [], []
        for t, event, _, _ in ready:
            passed, free = pass_count(t, 1, free, interval_us, burst)
            ids.append(event)
            accepted.append(bool(passed))
        return free, {"event_id": ids, "accepted": accepted}

    nothing = F.lit(0)
    return _stateful(
        stream, key, moment, event_id, delay, decide, "event_id long, accepted boolean", nothing, nothing, lambda free: free
    )


def dedup_window(stream: DataFrame, key: Column, moment: str, event_id: str, seconds: float = 60, delay: str = "1 minute") -> DataFrame:
    """``k, event_id`` of the events that open a window; duplicates do not extend it."""
    decided = token_bucket(stream, key, moment, event_id, int(seconds * 1_000_000), 1, delay)
    return decided.where("accepted").drop("accepted")


def throttle(stream: DataFrame, key: Column, moment: str, event_id: str, min_interval_seconds: float, delay: str = "1 minute") -> DataFrame:
    return dedup_window(stream, key, moment, event_id, min_interval_seconds, delay)


def dedup_approximate(stream: DataFrame, keys: Sequence[str], moment: str, delay: str) -> DataFrame:
    """Built-in deduplication: keeps a key's first event for at least ``delay``, often longer."""
    return with_event_time(stream, moment, delay).dropDuplicatesWithinWatermark(list(keys))


def admission(
    stream: DataFrame,
    queue: Column,
    moment: str,
    event_id: str,
    change: Column,
    priority: Column,
    delay: str = "1 minute",
    critical: int = 100,
    reject: int = 200,
) -> DataFrame:
    """Admission of each arrival by the depth of its queue just before it."""

    def decide(depth: int, ready: list) -> tuple[int, dict]:
        depth = 0 if depth == NEVER else depth
        ids, depths, levels = [], [], []
        for _, event, step, level in ready:
            if step > 0:
                ids.append(event)
                depths.append(depth)
                levels.append(level)
            depth += step
        return depth, {"event_id": ids, "depth": depths, "priority": levels}

    decided = _stateful(
        stream, queue, moment, event_id, delay, decide, "event_id long, depth long, priority int", change, priority,
        lambda depth: NEVER if depth in (0, NEVER) else None,
    )
    depth, urgent = F.col("depth"), F.col("priority")
    return decided.select(
        "k",
        "event_id",
        "depth",
        F.when((depth >= critical) & (urgent >= 2), 3).otherwise(urgent).alias("effective_priority"),
        F.when((depth >= reject) & (urgent >= 3), "REJECTED").otherwise("QUEUED").alias("result"),
        pressure_level(depth, critical // 2, critical, reject).alias("pressure"),
    )


def debounce(stream: DataFrame, key: str, moment: str, path: str, gap: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """One row per quiet-separated run of a watch root, flushed after silence.

    ``paths`` is the estimated number of distinct paths (a sketch of fixed
    size); the paths themselves follow from the run's bounds in the stored events.
    """
    return (
        with_event_time(stream, moment, delay)
        .groupBy(F.session_window(F.col(f"`{moment}`"), gap), F.col(f"`{key}`"))
        .agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct(F.col(f"`{path}`"), 0.02).alias("paths"))
        .select(
            key,
            F.col("session_window.start").alias("first_event"),
            F.col("session_window.end").alias("flush_at"),
            "events",
            "paths",
        )
    )


def tumbling_metrics(stream: DataFrame, moment: str, width: str = "1 minute", by: Sequence[str] = (), delay: str = "1 minute") -> DataFrame:
    return _windowed(stream, moment, F.window(F.col(f"`{moment}`"), width), by, delay)


def sliding_metrics(stream: DataFrame, moment: str, width: str, slide: str, by: Sequence[str] = (), delay: str = "1 minute") -> DataFrame:
    return _windowed(stream, moment, F.window(F.col(f"`{moment}`"), width, slide), by, delay)


def _windowed(stream: DataFrame, moment: str, window: Column, by: Sequence[str], delay: str) -> DataFrame:
    return (
        with_event_time(stream, moment, delay)
        .groupBy(window, *by)
        .agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("value")).alias("total"))
        .select(F.col("window.start").alias("window_start"), *by, "n", "total")
    )


def burst_windows(stream: DataFrame, moment: str, width: str, threshold: int, by: Sequence[str] = (), delay: str = "1 minute") -> DataFrame:
    counted = _windowed(stream.withColumn("value", F.lit(0)), moment, F.window(F.col(f"`{moment}`"), width), by, delay)
    return counted.where(F.col("n") > threshold).drop("total")


def stale_slots(acquired: DataFrame, released: DataFrame, slot: str, moment: str, max_age: str = "1 hour", delay: str = "1 minute") -> DataFrame:
    """Slots without a release within ``max_age`` of being acquired, found by an outer join with a time bound."""
    a = with_event_time(acquired, moment, delay).select(F.col(slot), F.col(moment))
    r = with_event_time(released, moment, delay).select(F.col(slot).alias("__slot"), F.col(moment).alias("__released"))
    in_time = F.expr(f"`{slot}` = __slot AND __released >= `{moment}` AND __released <= `{moment}` + INTERVAL {max_age}")
    return a.join(r, in_time, "leftOuter").where(F.col("__slot").isNull()).select(slot, moment)


# --- findings --------------------------------------------------------------


def marked_by_rules(batch: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows with the names of the rules they break and a verdict, ``good`` or ``bad``."""
    names = F.filter(
        F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules if r.enabled]), lambda x: x.isNotNull()
    )
    marked = batch.withColumn("broken_rules", names)
    return marked.withColumn("verdict", F.when(F.size("broken_rules") == 0, "good").otherwise("bad"))


def split_by_rules(batch: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the names of the rules they break."""
    marked = marked_by_rules(batch, rules)
    return (
        marked.where("verdict = 'good'").drop("broken_rules", "verdict"),
        marked.where("verdict = 'bad'").drop("verdict"),
    )


def findings_sink(stream: DataFrame, rules: Sequence[Rule], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the rows of each trigger with their verdict, partitioned by trigger and verdict.

    A trigger is written in one go and owns its ``batch_id`` partition, which
    it replaces, so a repeated trigger after a failure leaves the same files.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        marked_by_rules(batch, rules).write.mode("overwrite").partitionBy("verdict").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream in append mode over what its source holds now and read the rows that it gave out.

    Each trigger replaces its own partition of the table at ``path``.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode("append")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path).drop("batch_id")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark dropped, over the progress reports that the query still holds."""
    total = 0
    for progress in query.recentProgress:
        for operator in progress["stateOperators"]:
            total += operator["numRowsDroppedByWatermark"]
    return total
