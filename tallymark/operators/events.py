"""Event-time operators in batch form.

Deduplication, throttling and rate limiting are one rule with different
numbers. A key has a *free time*: an event at ``t`` passes while
``free <= t + (burst - 1) * interval`` and then moves it to
``max(free, t) + interval``. With ``burst = 1`` that lets an event pass once
per interval (deduplication window, throttle); with more it is a token bucket
that refills one token per interval and holds ``burst`` of them.

Whether an event passes depends on the events that passed before it, so a key
has to be walked in time order. The events are range-partitioned by key and
time, so a key with many events lies in several slices. Only keys that cross a
border between slices, at most one per border, need more: each of their slices
is summarised as a function from the free time at its start to the free time at
its end (piecewise, few pieces because different starts soon meet the same
events), the summaries are composed per block and per key, and then all slices
run independently from their now known start.

A missing key is a key like any other. An event without a time has no place in
the order: it neither passes nor is it told to wait.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.scalars import age_seconds, pressure_level
from tallymark.operators.shape import exact_sum
from tallymark.operators.windows import join_slices, running_sum, with_slices
from tallymark.session import stored
from tallymark.specs import DEFAULT_LIMITS

NEVER = -(1 << 62)
# Slices that are composed together.
_BLOCK = 64


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


# --- the pass rule ---------------------------------------------------------


def pass_count(t: int, n: int, free: int, interval: int, burst: int) -> tuple[int, int]:
    """How many of ``n`` events at ``t`` pass, and the free time afterwards."""
    start = free if free > t else t
    room = t + (burst - 1) * interval - start
    if room < 0:
        return 0, free
    passed = min(n, room // interval + 1)
    return passed, start + passed * interval


def _trace_slice(t: np.ndarray, n: np.ndarray, free: int, top: int, interval: int, burst: int) -> tuple[int, int, int]:
    """Walk a slice from ``free``; returns (result, slope, last start with the same decisions).

    While the slope is 1 the result moves with the start; it becomes 0 once the
    bucket is full at some event, after which the start is forgotten.
    """
    slack = (burst - 1) * interval
    start, slope, limit, i = free, 1, top, 0
    while i < len(t):
        ti = int(t[i])
        if free <= ti:
            if slope:
                limit, slope = min(limit, start + ti - free), 0
            free = ti
        room = ti + slack - free
        if room < 0:
            i = int(np.searchsorted(t, free - slack))
            continue
        fits = room // interval + 1
        passed = min(int(n[i]), fits)
        if slope:
            spare = room - (passed - 1) * interval
            limit = min(limit, start + spare)
        free += passed * interval
        i += 1
    return free, slope, limit


def _slice_function(t: np.ndarray, n: np.ndarray, interval: int, burst: int) -> tuple[list[int], list[int], list[int]]:
    """The free time after a slice as a piecewise function of the one before it, on [t[0], t[0] + burst * interval].

    Until the bucket is full at some event, a start only moves by whole
    intervals: before event ``i`` it is the greatest value that differs from it
    by whole intervals and is at most ``cap[i]`` and the start, plus one interval
    for each event so far. Starts that meet a full bucket first at the same event
    have the same result. So pieces come from the few starts, cut at the last
    cap, and from the first full buckets, and not from every decision.
    """
    slack, bottom = (burst - 1) * interval, int(t[0])
    top = bottom + burst * interval
    before = np.concatenate(([0], np.cumsum(n))) * interval
    # The bound that an event sets, without the intervals of the events so far; the first entry bounds nothing.
    cap = np.minimum.accumulate(np.concatenate(([top], t + slack + interval - before[1:])))
    full = t - before[:-1]
    ends = np.full(len(t), NEVER)

    def after_full(i: int) -> int:
        """Result of a bucket that is full at event ``i``; known from the next full one on."""
        passed, free = [], int(t[i])
        while i < len(t):
            if free <= t[i]:
                if ends[i] != NEVER:
                    free = int(ends[i])
                    break
                passed.append(i)
            count, free = pass_count(int(t[i]), int(n[i]), free, interval, burst)
            i = i + 1 if count else max(i + 1, int(np.searchsorted(t, free - slack)))
        ends[passed] = free
        return free

    found: list[tuple[int, int, int]] = []
    open_ = [(bottom, top)]
    # A start is full at an event if its reduced value is at most ``full``: all values from the cap on, or a band below it.
    for i in np.flatnonzero((full >= bottom) | (full > cap[:-1] - interval)).tolist():
        limit, level = int(cap[i]), int(full[i])
        left = []
        for lo, hi in open_:
            bands = [(bottom, min(level, limit))] if level < limit else [(bottom, top)]
            if limit - interval < level < limit:
                # The same phases one interval and more above the cap.
                above = range(max(0, -((level - lo) // interval) - 1), (hi - limit - 1) // interval + 1)
                bands += [(limit + 1 + k * interval, level + (k + 1) * interval) for k in above]
            for x, y in bands:
                x, y = max(x, lo), min(y, hi)
                if x > y:
                    continue
                if x > lo:
                    left.append((lo, x - 1))
                found.append((x, after_full(i), 0))
                lo = y + 1
            if lo <= hi:
                left.append((lo, hi))
        open_ = left
        if not open_:
            break
    last, moved = int(cap[-1]), int(before[-1])
    for lo, hi in open_:
        while lo <= hi:
            over = max(0, -((last - lo) // interval))
            found.append((lo, lo - over * interval + moved, 1))
            lo = last + over * interval + 1
    return _merged(sorted(found))


def _merged(pieces: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Starts, values and slopes; a piece that goes on like the one before it is left out."""
    kept: list[tuple[int, int, int]] = []
    for at, value, slope in pieces:
        if not (kept and kept[-1][2] == slope and kept[-1][1] + slope * (at - kept[-1][0]) == value):
            kept.append((at, value, slope))
    return [p[0] for p in kept], [p[1] for p in kept], [p[2] for p in kept]


def _pieces(trace, bottom: int, top: int) -> tuple[list[int], list[int], list[int]]:
    """Piecewise function on [bottom, top] from a trace."""
    found, at = [], bottom
    while at <= top:
        value, slope, limit = trace(at, top)
        found.append((at, value, slope))
        at = limit + 1
    return _merged(found)


def _apply(piece: tuple, free: int, top: int) -> tuple[int, int, int]:
    """Value of a stored function at ``free`` with slope and the last start on the same piece."""
    bottom, starts, values, slopes = piece
    if free < bottom:
        return values[0], 0, bottom - 1
    k = int(np.searchsorted(starts, free, side="right")) - 1
    last = int(starts[k + 1]) - 1 if k + 1 < len(starts) else top
    return int(values[k]) + int(slopes[k]) * (free - int(starts[k])), int(slopes[k]), last


def _trace_chain(functions: Sequence[tuple], free: int, top: int) -> tuple[int, int, int]:
    start, slope, limit = free, 1, top
    for f in functions:
        value, s, last = _apply(f, free, 1 << 62)
        if slope:
            limit = min(limit, start + (last - free))
        free, slope = value, slope * s
    return free, slope, limit


_FUNCTION = "starts array<long>, values array<long>, slopes array<long>"


def _summarise():
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, n = pdf["t"].to_numpy(), pdf["n"].to_numpy()
        interval, burst = int(pdf["step"].iloc[0]), int(pdf["burst"].iloc[0])
        found = _slice_function(t, n, interval, burst)
        pieces = {"starts": [found[0]], "values": [found[1]], "slopes": [found[2]]}
        return pd.DataFrame({"k": [key[0]], "slice": [key[1]], "step": [interval], "burst": [burst], **pieces})

    return run


def _stored(pdf: pd.DataFrame) -> list[tuple]:
    return [
        (int(s[0]), np.asarray(s, dtype="int64"), np.asarray(v, dtype="int64"), np.asarray(d, dtype="int64"))
        for s, v, d in zip(pdf["starts"], pdf["values"], pdf["slopes"])
    ]


def _compose():
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        functions = _stored(pdf.sort_values("slice"))
        interval, burst = int(pdf["step"].iloc[0]), int(pdf["burst"].iloc[0])
        bottom = functions[0][0]
        found = _pieces(lambda a, b: _trace_chain(functions, a, b), bottom, bottom + burst * interval)
        return pd.DataFrame({"k": [key[0]], "block": [key[1]], "starts": [found[0]], "values": [found[1]], "slopes": [found[2]]})

    return run


def _entries(order: str):
    """Free time at the start of each function of a group, from the group's own ``entry``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        free, found = int(pdf["entry"].iloc[0]), []
        for f in _stored(pdf):
            found.append(free)
            free = _apply(f, free, 1 << 62)[0]
        return pd.DataFrame({"k": pdf["k"].to_numpy(), order: pdf[order].to_numpy(), "entry": found})

    return run


def _walk():
    """Decide sorted ticks; groups are runs of equal (key, slice), and memory holds one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free = None, NEVER
        for pdf in batches:
            if pdf.empty:
                continue
            k, part = pdf["k"].to_numpy(), pdf["slice"].to_numpy()
            t, n = pdf["t"].to_numpy(), pdf["n"].to_numpy()
            passed, wait = np.zeros(len(pdf), dtype="int64"), np.zeros(len(pdf), dtype="int64")
            begin = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (part[1:] != part[:-1]))))
            for a, b in zip(begin, [*begin[1:], len(pdf)]):
                if current != (k[a], part[a]):
                    current, free = (k[a], part[a]), int(pdf["entry"].iat[a])
                interval, burst = int(pdf["step"].iat[a]), int(pdf["burst"].iat[a])
                slack, i = (burst - 1) * interval, a
                while i < b:
                    passed[i], after = pass_count(int(t[i]), int(n[i]), free, interval, burst)
                    free = after
                    if passed[i] == n[i]:
                        i += 1
                        continue
                    # Nothing passes before the next token; those times are skipped together.
                    ready = max(i + 1, a + int(np.searchsorted(t[a:b], free - slack)))
                    wait[i:ready] = free - slack - t[i:ready]
                    i = ready
            yield pd.DataFrame({"k": k, "t": t, "first_id": pdf["first_id"], "n": n, "passed": passed, "wait_us": wait})

    return run


def key_text(key: Column) -> Column:
    """The key as text that joins and groups like any value, also when it is missing."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def _ticking(events: DataFrame, key: Column, moment: str, event_id: str) -> DataFrame:
    return events.select(key_text(key).alias("k"), micros(F.col(f"`{moment}`")).alias("t"), F.col(f"`{event_id}`").alias("__id"))


def _amount(value: int | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")


def decide_ticks(
    events: DataFrame,
    key: Column,
    moment: str,
    event_id: str,
    interval_us: int | Column,
    burst: int | Column,
    slices: int | None = None,
) -> DataFrame:
    """Per key and distinct time: number of events ``n``, how many ``passed``, wait of the others, smallest id.

    Interval and burst may be columns that are equal for all events of a key.
    Events at the same time are one row before any shuffle. The number of
    slices follows the size of the data unless given.
    """
    t = micros(F.col(f"`{moment}`"))
    slim = events.select(
        key_text(key).alias("k"), t.alias("t"), F.col(f"`{event_id}`").alias("__id"), _amount(interval_us).alias("step"), _amount(burst).alias("burst")
    ).where(F.col("t").isNotNull())
    ticks = slim.groupBy("k", "t", "step", "burst").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first_id"))
    ranged = ticks.repartitionByRange(slices, "k", "t") if slices else ticks.repartitionByRange("k", "t")
    laid = stored(ranged.withColumn("slice", F.spark_partition_id().cast("long")))
    crossing = laid.groupBy("k").agg(F.min("slice").alias("lo"), F.max("slice").alias("hi")).where("lo < hi").select("k")
    entries = _slice_entries(laid.join(crossing, "k", "left_semi")).select(
        F.col("k").alias("e_k"), F.col("slice").alias("e_slice"), F.col("entry").alias("known")
    )
    started = laid.join(entries, (F.col("k") == F.col("e_k")) & (F.col("slice") == F.col("e_slice")), "left").select(
        "k", "slice", "t", "n", "first_id", "step", "burst", F.coalesce("known", F.lit(NEVER)).alias("entry")
    )
    id_type = events.schema[event_id].dataType.simpleString()
    return (
        started.repartition("k", "slice")
        .sortWithinPartitions("k", "slice", "t")
        .mapInPandas(_walk(), f"k string, t long, first_id {id_type}, n long, passed long, wait_us long")
    )


def _slice_entries(sliced: DataFrame) -> DataFrame:
    """Free time at the start of every slice: summarise slices, compose blocks of them, then resolve both."""
    functions = stored(
        sliced.select("k", "slice", "t", "n", "step", "burst")
        .groupBy("k", "slice")
        .applyInPandas(_summarise(), f"k string, slice long, step long, burst long, {_FUNCTION}")
        .withColumn("block", F.floor(F.col("slice") / F.lit(_BLOCK)).cast("long"))
    )
    blocks = functions.groupBy("k", "block").applyInPandas(_compose(), f"k string, block long, {_FUNCTION}")
    block_entries = blocks.withColumn("entry", F.lit(NEVER)).groupBy("k").applyInPandas(
        _entries("block"), "k string, block long, entry long"
    )
    return functions.join(block_entries, ["k", "block"]).groupBy("k", "block").applyInPandas(
        _entries("slice"), "k string, slice long, entry long"
    )


def passing_events(
    events: DataFrame, key: Column, moment: str, event_id: str, interval_us: int | Column, burst: int | Column, **tuning
) -> DataFrame:
    """The events that pass. Of several at one time the smaller ids go first."""
    ticks = decide_ticks(events, key, moment, event_id, interval_us, burst, **tuning).where("passed > 0")
    if isinstance(burst, int) and burst == 1:
        chosen = ticks.select(F.col("first_id").alias(event_id))
    else:
        same_time = Window.partitionBy("k", "t").orderBy("__id")
        ranked = (
            _ticking(events, key, moment, event_id)
            .withColumn("rn", F.row_number().over(same_time))
            .where(F.col("rn") <= burst)
        )
        chosen = (
            ranked.join(ticks.select("k", "t", "passed"), ["k", "t"])
            .where(F.col("rn") <= F.col("passed"))
            .select(F.col("__id").alias(event_id))
        )
    return events.join(chosen, event_id, "left_semi")


def dedup_window(events: DataFrame, key: Column, moment: str, event_id: str, seconds: float = 60, **tuning) -> DataFrame:
    """First event per key, then the next one at least ``seconds`` after the last that was kept."""
    return passing_events(events, key, moment, event_id, int(seconds * 1_000_000), 1, **tuning)


def throttle(events: DataFrame, key: Column, moment: str, event_id: str, min_interval_seconds: float, **tuning) -> DataFrame:
    return passing_events(events, key, moment, event_id, int(min_interval_seconds * 1_000_000), 1, **tuning)


def token_bucket(
    events: DataFrame, key: Column, moment: str, event_id: str, interval_us: int | Column, burst: int | Column, **tuning
) -> DataFrame:
    """All events with ``accepted`` and, for refused ones, the seconds until a token is free."""
    ticks = stored(decide_ticks(events, key, moment, event_id, interval_us, burst, **tuning))
    most = ticks.select("k", "t", "passed").where("passed > 0")
    same_time = Window.partitionBy("k", "t").orderBy("__id")
    first = _ticking(events, key, moment, event_id).withColumn("rn", F.row_number().over(same_time))
    accepted = (
        first.join(most, ["k", "t"])
        .where(F.col("rn") <= F.col("passed"))
        .select("__id", F.lit(True).alias("accepted"))
    )
    waits = ticks.where("wait_us > 0").select(F.col("k").alias("__k"), F.col("t").alias("__t"), "wait_us")
    joined = (
        events.join(accepted, F.col(f"`{event_id}`") == F.col("__id"), "left")
        .join(waits, (key_text(key) == F.col("__k")) & (micros(F.col(f"`{moment}`")) == F.col("__t")), "left")
    )
    ok = F.coalesce("accepted", F.lit(False))
    return joined.select(
        *[F.col(f"`{c}`") for c in events.columns],
        ok.alias("accepted"),
        F.when(~ok, F.col("wait_us") / F.lit(1_000_000.0)).alias("wait_seconds"),
    )


# --- sessions --------------------------------------------------------------


def with_session(events: DataFrame, key: str, moment: str, event_id: str, gap: float = 5, slices: int | None = None) -> DataFrame:
    """Number the runs of events of a key that are at most ``gap`` seconds apart.

    Each slice counts the runs that start inside it; whether its first event
    starts one too, and how many runs came before, follows from the slices'
    first and last times.
    """
    limit = F.lit(int(gap * 1_000_000))
    t = micros(F.col(f"`{moment}`"))
    parts = [F.col(f"`{key}`"), F.col("__slice")]
    inside = Window.partitionBy(*parts).orderBy(F.col(f"`{moment}`"), F.col(f"`{event_id}`"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        with_slices(events, [key], moment, event_id, slices)
        .withColumn("__starts", F.when(t - F.lag(t).over(inside) > limit, 1).otherwise(0))
        .withColumn("__run", F.sum("__starts").over(upto))
    )
    slices = local.groupBy(*parts).agg(
        F.min(t).alias("__first"), F.max(t).alias("__last"), F.sum("__starts").alias("__inner")
    )
    over = Window.partitionBy(F.col(f"`{key}`")).orderBy("__slice")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    opened = slices.withColumn(
        "__opens", F.when(F.col("__first") - F.lag("__last").over(over) <= limit, 0).otherwise(1)
    ).withColumn("__base", F.sum(F.col("__inner") + F.col("__opens")).over(earlier))
    joined = join_slices(local, opened, [key], ["__opens", "__base"])
    number = F.coalesce(F.col("__base"), F.lit(0)) + F.col("__opens") + F.col("__run")
    return joined.select(*[F.col(f"`{c}`") for c in events.columns], number.cast("long").alias("session"))


def debounce(events: DataFrame, key: str, moment: str, event_id: str, path: str, gap: float = 5, slices: int | None = None) -> DataFrame:
    """One row per quiet-separated run: first and last event, flush time, events and distinct paths."""
    sessions = with_session(events, key, moment, event_id, gap, slices)
    per_path = sessions.groupBy(key, "session", path).agg(
        F.count(F.lit(1)).alias("n"), F.min(moment).alias("first"), F.max(moment).alias("last")
    )
    return per_path.groupBy(key, "session").agg(
        F.min("first").alias("first_event"),
        F.max("last").alias("last_event"),
        (F.max("last") + F.make_dt_interval(secs=F.lit(gap).cast("decimal(18,6)"))).alias("flush_at"),
        F.sum("n").alias("events"),
        F.count(path).alias("paths"),
    ).drop("session")


def debounced_paths(events: DataFrame, key: str, moment: str, event_id: str, path: str, gap: float = 5, slices: int | None = None) -> DataFrame:
    """The distinct paths of each run as rows."""
    return with_session(events, key, moment, event_id, gap, slices).select(key, "session", path).distinct()


# --- bursts and queues -----------------------------------------------------


def burst_batches(events: DataFrame, files: str, priority: str, event_id: str, threshold: int = 10) -> DataFrame:
    """One row per file; an event with more than ``threshold`` files is a batch, and its priority above 1 becomes 3."""
    burst = F.size(F.col(f"`{files}`")) > threshold
    batch = F.substring(F.sha2(F.concat(F.lit("batch:"), F.col(f"`{event_id}`").cast("string")), 256), 1, 16)
    return events.select(
        F.col(f"`{event_id}`"),
        F.when(burst, batch).alias("batch_id"),
        F.when(burst & (F.col(f"`{priority}`") > 1), 3).otherwise(F.col(f"`{priority}`")).alias("priority"),
        F.explode(F.col(f"`{files}`")).alias("job_path"),
    )


def burst_windows(events: DataFrame, moment: str, width: str, threshold: int, by: Sequence[str] = ()) -> DataFrame:
    """Time windows with more than ``threshold`` events."""
    return (
        events.groupBy(F.window(F.col(f"`{moment}`"), width), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > threshold)
        .select(F.col("window.start").alias("window_start"), *by, "n")
    )


def admission(
    events: DataFrame,
    queue: str,
    moment: str,
    event_id: str,
    change: str,
    priority: str,
    duplicate: Column | None = None,
    limited: Column | None = None,
    critical: int = 100,
    reject: int = 200,
    slices: int | None = None,
) -> DataFrame:
    """Admission of each arrival (``change`` > 0) by the depth of its queue just before it.

    Batch requests are rejected at ``reject``; requests of priority 2 and 3
    become 3 at ``critical``. Duplicates and rate-limited requests are given as
    conditions and take part in the order duplicate, rejected, limited.
    """
    depth_after = running_sum(events, [queue], moment, event_id, change, "__depth", slices)
    depth = F.col("__depth") - F.col(f"`{change}`")
    urgent = F.col(f"`{priority}`")
    effective = F.when((depth >= critical) & (urgent >= 2), 3).otherwise(urgent)
    result = (
        F.when(F.lit(False) if duplicate is None else duplicate, "DEDUPLICATED")
        .when((depth >= reject) & (urgent >= 3), "REJECTED")
        .when(F.lit(False) if limited is None else limited, "RATE_LIMITED")
        .otherwise("QUEUED")
    )
    return (
        depth_after.where(F.col(f"`{change}`") > 0)
        .withColumns({"depth": depth, "effective_priority": effective, "result": result})
        .withColumn("pressure", pressure_level(F.col("depth"), critical // 2, critical, reject))
        .drop("__depth")
    )


def stale_slots(slots: DataFrame, as_of: datetime, max_age_seconds: float = 3600) -> DataFrame:
    """Slots acquired, never released and older than ``max_age_seconds``. Rows: ``slot_id, action, ts``."""
    released = slots.where(F.col("action") == "release").select("slot_id").distinct()
    age = age_seconds(F.col("ts"), F.lit(as_of).cast("timestamp"))
    return (
        slots.where(F.col("action") == "acquire")
        .join(released, "slot_id", "left_anti")
        .withColumn("age_seconds", age)
        .where(F.col("age_seconds") > F.lit(float(max_age_seconds)))
        .drop("action")
    )


# --- metrics over time -----------------------------------------------------


def tumbling_metrics(events: DataFrame, moment: str, width: str = "1 minute", by: Sequence[str] = ()) -> DataFrame:
    """Events and mean value per window."""
    return _windowed(events, F.window(F.col(f"`{moment}`"), width), by)


def sliding_metrics(events: DataFrame, moment: str, width: str, slide: str, by: Sequence[str] = ()) -> DataFrame:
    return _windowed(events, F.window(F.col(f"`{moment}`"), width, slide), by)


def _windowed(events: DataFrame, window: Column, by: Sequence[str]) -> DataFrame:
    return (
        events.groupBy(window, *by)
        .agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("value")).alias("total"))
        .select(F.col("window.start").alias("window_start"), *by, "n", "total")
    )


def rolling_series(points: DataFrame, series: str, moment: str, start: datetime | None, n: int = 100) -> DataFrame:
    """The last ``n`` points of each series since ``start``."""
    rows = points if start is None else points.where(F.col(f"`{moment}`") >= F.lit(start).cast(points.schema[moment].dataType))
    newest = Window.partitionBy(F.col(f"`{series}`")).orderBy(F.desc(moment), F.desc("value"))
    return rows.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n).drop("__rn")


def limit_by_priority(events: DataFrame, priority: str, moment: str, event_id: str, limits=None, **tuning) -> DataFrame:
    """Token buckets per priority, all decided in one walk; a priority without a limit always passes."""
    level = F.col(f"`{priority}`")
    limits = DEFAULT_LIMITS if limits is None else limits
    free = F.coalesce(~level.isin(*limits), F.lit(True))
    decided = events.where(free).withColumns({"accepted": F.lit(True), "wait_seconds": F.lit(None).cast("double")})

    def of(field: str) -> Column:
        return F.coalesce(*[F.when(level == number, F.lit(getattr(limit, field))) for number, limit in sorted(limits.items())])

    bucket = token_bucket(events.where(~free), level, moment, event_id, of("interval_us"), of("burst"), **tuning)
    return decided.unionByName(bucket)
