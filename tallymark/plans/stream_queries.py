"""Registered streaming queries: the events as a stream of slices of time, run to its end.

Each slice is staged when the one before has been read, and is one trigger,
however many files it has: later slices hold later events only, so the
watermark makes none late.  Slices with a far later event at the end let it
pass every event.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.plans.event_queries import HOUR_US, SLIDING_SQL, TUMBLING_SQL, greedy, token_walk
from tallymark.plans.fixtures import fixture, read, with_fixtures
from tallymark.plans.registry import query
from tallymark.session import fresh_path
from tallymark.specs import Rule
from tallymark.streaming import events as live

_SLICES = 3
_END = datetime(2100, 1, 1)


def _staged(events: DataFrame, moment: str = "ts", key: str | None = None) -> tuple[DataFrame, Iterator[None]]:
    """The rows as a stream, and its feed: each step adds a slice. Rows without a time come first, two marks last.

    A mark is null in all columns but the time and ``key``, which is below zero.
    """
    spark, folder = events.sparkSession, fresh_path(events.sparkSession)
    when = F.unix_micros(F.col(moment).cast("timestamp"))
    first, last, untimed = events.agg(F.min(when), F.max(when), F.count_if(when.isNull())).first()
    slices = [events.where(when.isNull())] if untimed else []
    if first is not None:
        part = F.floor((when - first) * F.lit(_SLICES) / F.lit(last - first + 1))
        slices += [events.where(F.least(part, F.lit(_SLICES - 1)) == i) for i in range(_SLICES)]
    for i in range(2):
        mark = {moment: F.lit(_END.replace(year=_END.year + i))} | ({key: F.lit(-1 - i)} if key else {})
        # A join's key must not be null in a mark: rows that cannot be joined are dropped before they move the watermark.
        slices.append(spark.range(1).select(*[mark.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields]))
    # The source needs its folder from the start.
    slices[0].write.parquet(f"{folder}/0")

    def feed() -> Iterator[None]:
        yield
        for i, rows in enumerate(slices[1:], 1):
            rows.write.parquet(f"{folder}/{i}")
            yield

    return spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(folder), feed()


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Iterator[None]]:
    return _staged(read(spark, sf_dir, "events"))


def _finished(stream: DataFrame, *feeds: Iterator[None]) -> DataFrame:
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark), fresh_path(spark)
    for _ in zip_longest(*feeds):
        done = live.run_available(stream, path, checkpoint)
    return done


def _plain(done: DataFrame, *columns: str) -> DataFrame:
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _ended(done: DataFrame, column: str) -> DataFrame:
    """Without the marks."""
    return done.where(F.col(column) < F.lit(_END).cast(done.schema[column].dataType))


@query("stream_tumbling", TUMBLING_SQL)
def stream_tumbling(spark, sf_dir):
    events, feed = _stream(spark, sf_dir)
    done = _finished(live.tumbling_metrics(events, "ts", "1 minute", ["event_type"]), feed)
    return _plain(_ended(done, "window_start"), "window_start")


@query("stream_sliding", SLIDING_SQL)
def stream_sliding(spark, sf_dir):
    events, feed = _stream(spark, sf_dir)
    done = _finished(live.sliding_metrics(events, "ts", "3 hours", "1 hour", ["event_type"]), feed)
    return _plain(done.where("event_type is not null"), "window_start")


@query(
    "stream_debounce",
    """
    WITH sessions AS (
        SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
        FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))
                             <= 7200000000 THEN 0 ELSE 1 END AS s FROM events) x)
    SELECT user_id, min(ts) AS first_event, max(ts) + INTERVAL 2 HOUR AS flush_at, count(*) AS events
    FROM sessions GROUP BY user_id, session""",
)
def stream_debounce(spark, sf_dir):
    events, feed = _stream(spark, sf_dir)
    # Without the column the sketch of paths is not part of the state.
    done = _finished(live.debounce(events, "user_id", "ts", "event_type", "2 hours", "1 minute").drop("paths"), feed)
    return _plain(_ended(done, "first_event"), "first_event", "flush_at")


@query("stream_dedup_window", f"SELECT event_id FROM ({greedy('user_id', 6)}) k")
def stream_dedup_window(spark, sf_dir):
    events, feed = _stream(spark, sf_dir)
    done = _finished(live.dedup_window(events, F.col("user_id"), "ts", "event_id", 6 * 3600), feed)
    return done.select("event_id").where("event_id is not null")


@query("stream_throttle", f"SELECT event_id FROM ({greedy('event_type', 3)}) k")
def stream_throttle(spark, sf_dir):
    events, feed = _stream(spark, sf_dir)
    done = _finished(live.throttle(events, F.col("event_type"), "ts", "event_id", 3 * 3600), feed)
    return done.select("event_id").where("event_id is not null")


@query("stream_token_bucket", f"SELECT event_id, accepted FROM ({token_walk()}) k")
def stream_token_bucket(spark, sf_dir):
    events, feed = _stream(spark, sf_dir)
    done = _finished(live.token_bucket(events, F.col("user_id"), "ts", "event_id", 2 * HOUR_US, 3), feed)
    return done.select("event_id", "accepted").where("event_id is not null")


@query(
    "stream_admission",
    with_fixtures(
        """
        SELECT event_id, depth, CASE WHEN depth >= 100 AND priority >= 2 THEN 3 ELSE priority END AS effective_priority,
               CASE WHEN depth >= 200 AND priority >= 3 THEN 'REJECTED' ELSE 'QUEUED' END AS result
        FROM (SELECT *, CAST(sum(change) OVER (PARTITION BY queue ORDER BY ts, event_id) - change AS BIGINT) AS depth FROM arrivals) x
        WHERE change > 0"""
    ),
)
def stream_admission(spark, sf_dir):
    arrivals, feed = _staged(fixture(spark, sf_dir, "arrivals"))
    arrivals = arrivals.na.fill(0, ["change", "priority"])
    done = _finished(live.admission(arrivals, F.col("queue"), "ts", "event_id", F.col("change"), F.col("priority")), feed)
    return done.select("event_id", "depth", "effective_priority", "result").where("event_id is not null")


@query(
    "stream_burst_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
)
def stream_burst_windows(spark, sf_dir):
    events, feed = _stream(spark, sf_dir)
    return _plain(_finished(live.burst_windows(events, "ts", "1 hour", 1, ["event_type"]), feed), "window_start")


@query(
    "stream_stale_slots",
    with_fixtures(
        "SELECT slot_id, ts FROM slots s WHERE action = 'acquire'"
        " AND NOT EXISTS (SELECT 1 FROM slots r WHERE r.slot_id = s.slot_id AND r.action = 'release')"
    ),
)
def stream_stale_slots(spark, sf_dir):
    slots = fixture(spark, sf_dir, "slots")
    (acquired, taken), (released, given) = (_staged(slots.where(F.col("action") == a).drop("action"), key="slot_id") for a in ("acquire", "release"))
    done = _finished(live.stale_slots(acquired, released, "slot_id", "ts", "1 hour"), taken, given)
    return _plain(_ended(done, "ts"), "ts")


@query(
    "stream_findings",
    """
    SELECT event_id, CASE WHEN value > 40 AND event_type = 'error' THEN 'high_value,no_error'
                          WHEN value > 40 THEN 'high_value' WHEN event_type = 'error' THEN 'no_error' ELSE '' END AS broken
    FROM events""",
)
def stream_findings(spark, sf_dir):
    rules = [Rule("high_value", "value", "range", maximum=40), Rule("no_error", "event_type", "custom", expression="event_type <> 'error'")]
    path, checkpoint = fresh_path(spark), fresh_path(spark)
    events, feed = _stream(spark, sf_dir)
    for _ in feed:
        live.findings_sink(events, rules, path, checkpoint).awaitTermination()
    found = spark.read.parquet(path).where("event_id is not null")
    return found.select("event_id", F.array_join(F.array_sort("broken_rules"), ",").alias("broken"))
