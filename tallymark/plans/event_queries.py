"""Registered event-time queries in batch form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallymark.operators import events as e
from tallymark.operators.windows import running_sum
from tallymark.plans.fixtures import fixture, read, with_fixtures
from tallymark.plans.registry import query

HOUR_US = 3_600_000_000


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events")


def greedy(key: str, hours: int) -> str:
    """Walk each key: the next kept event is the first at least ``hours`` after the last kept one."""
    return f"""
        WITH RECURSIVE kept AS (
            SELECT {key} AS k, min(ts) AS ts FROM events GROUP BY {key}
            UNION ALL
            SELECT kept.k, min(e.ts) FROM kept JOIN events e ON e.{key} = kept.k AND e.ts >= kept.ts + INTERVAL {hours} HOUR
            GROUP BY kept.k)
        SELECT e.event_id, e.{key}, e.ts FROM events e JOIN kept ON e.{key} = kept.k AND e.ts = kept.ts"""


@query("ev_dedup_window", greedy("user_id", 6))
def ev_dedup_window(spark, sf_dir):
    kept = e.dedup_window(_events(spark, sf_dir), F.col("user_id"), "ts", "event_id", 6 * 3600)
    return kept.select("event_id", "user_id", "ts")


@query("ev_throttle", greedy("event_type", 3))
def ev_throttle(spark, sf_dir):
    # Five keys hold all events; more slices than keys make them cross the borders even for this little data.
    kept = e.throttle(
        _events(spark, sf_dir), F.col("event_type"), "ts", "event_id", 3 * 3600, slices=16
    )
    return kept.select("event_id", "event_type", "ts")


def token_walk() -> str:
    """Decisions of a bucket of three tokens that gains one every two hours, per user."""
    return f"""
    WITH RECURSIVE o AS (
        SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
        SELECT event_id, user_id, rn, true AS accepted, CAST(NULL AS DOUBLE) AS wait_seconds, t + {2 * HOUR_US} AS free FROM o WHERE rn = 1
        UNION ALL
        SELECT o.event_id, o.user_id, o.rn, w.free <= o.t + {4 * HOUR_US},
               CASE WHEN w.free > o.t + {4 * HOUR_US} THEN (w.free - {4 * HOUR_US} - o.t) / 1000000.0::DOUBLE END,
               CASE WHEN w.free <= o.t + {4 * HOUR_US} THEN greatest(w.free, o.t) + {2 * HOUR_US} ELSE w.free END
        FROM walk w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
    SELECT event_id, accepted, wait_seconds FROM walk"""


@query("ev_token_bucket", token_walk())
def ev_token_bucket(spark, sf_dir):
    decided = e.token_bucket(_events(spark, sf_dir), F.col("user_id"), "ts", "event_id", 2 * HOUR_US, 3)
    return decided.select("event_id", "accepted", "wait_seconds")


@query(
    "ev_priority_limits",
    with_fixtures(
        """
        SELECT event_id, priority, accepted FROM walk
        UNION ALL SELECT event_id, priority, true FROM arrivals WHERE priority = 0""",
        """o AS (
            SELECT event_id, a.priority, epoch_us(ts) AS t, step, step * (burst - 1) AS slack,
                   row_number() OVER (PARTITION BY a.priority ORDER BY ts, event_id) AS rn
            FROM arrivals a JOIN (VALUES (1, 6000000, 5), (2, 2000000, 10), (3, 600000, 20)) AS l(priority, step, burst)
              ON l.priority = a.priority)""",
        """walk AS (
            SELECT event_id, priority, rn, true AS accepted, t + step AS free FROM o WHERE rn = 1
            UNION ALL
            SELECT o.event_id, o.priority, o.rn, w.free <= o.t + o.slack,
                   CASE WHEN w.free <= o.t + o.slack THEN greatest(w.free, o.t) + o.step ELSE w.free END
            FROM walk w JOIN o ON o.priority = w.priority AND o.rn = w.rn + 1)""",
        recursive=True,
    ),
)
def ev_priority_limits(spark, sf_dir):
    arrivals = fixture(spark, sf_dir, "arrivals")
    return e.limit_by_priority(arrivals, "priority", "ts", "event_id").select("event_id", "priority", "accepted")


_SESSIONS = """
    sessions AS (
        SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
        FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))
                             <= 7200000000 THEN 0 ELSE 1 END AS s FROM events) x)"""


@query(
    "ev_debounce",
    f"""
    WITH {_SESSIONS}
    SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, max(ts) + INTERVAL 2 HOUR AS flush_at,
           count(*) AS events, count(DISTINCT event_type) AS paths
    FROM sessions GROUP BY user_id, session""",
)
def ev_debounce(spark, sf_dir):
    return e.debounce(_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type", 7200)


@query(
    "ev_debounced_paths",
    f"WITH {_SESSIONS} SELECT DISTINCT user_id, CAST(session AS BIGINT) AS session, event_type FROM sessions",
)
def ev_debounced_paths(spark, sf_dir):
    return e.debounced_paths(_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type", 7200)


@query(
    "ev_burst",
    """
    SELECT event_id, CASE WHEN event_id % 15 > 10 THEN substr(sha256('batch:' || event_id), 1, 16) END AS batch_id,
           CASE WHEN event_id % 15 > 10 AND event_id % 4 > 1 THEN 3 ELSE CAST(event_id % 4 AS INT) END AS priority,
           concat('/jobs/', CAST(unnest(range(1, event_id % 15 + 1)) AS VARCHAR), '.py') AS job_path
    FROM events""",
)
def ev_burst(spark, sf_dir):
    size = (F.col("event_id") % 15).cast("int")
    files = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.lit("/jobs/"), i.cast("string"), F.lit(".py"))))
    events = _events(spark, sf_dir).select(
        "event_id", (F.col("event_id") % 4).cast("int").alias("priority"), files.alias("files")
    )
    return e.burst_batches(events, "files", "priority", "event_id")


@query(
    "ev_burst_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
)
def ev_burst_windows(spark, sf_dir):
    return e.burst_windows(_events(spark, sf_dir), "ts", "1 hour", 1, ["event_type"])


@query(
    "ev_running_depth",
    with_fixtures(
        "SELECT event_id, CAST(sum(change) OVER (PARTITION BY queue ORDER BY ts, event_id) AS BIGINT) AS depth FROM arrivals"
    ),
)
def ev_running_depth(spark, sf_dir):
    return running_sum(fixture(spark, sf_dir, "arrivals"), ["queue"], "ts", "event_id", "change", "depth").select("event_id", "depth")


@query(
    "ev_admission",
    with_fixtures(
        """
        SELECT event_id, depth, CASE WHEN depth >= 100 AND priority >= 2 THEN 3 ELSE priority END AS effective_priority,
               CASE WHEN event_id % 17 = 0 THEN 'DEDUPLICATED' WHEN depth >= 200 AND priority >= 3 THEN 'REJECTED'
                    WHEN event_id % 19 = 0 THEN 'RATE_LIMITED' ELSE 'QUEUED' END AS result,
               CASE WHEN depth >= 200 THEN 'reject' WHEN depth >= 100 THEN 'critical' WHEN depth >= 50 THEN 'warning'
                    ELSE 'normal' END AS pressure
        FROM (SELECT *, CAST(sum(change) OVER (PARTITION BY queue ORDER BY ts, event_id) - change AS BIGINT) AS depth FROM arrivals) x
        WHERE change > 0"""
    ),
)
def ev_admission(spark, sf_dir):
    key = F.col("event_id")
    found = e.admission(
        fixture(spark, sf_dir, "arrivals"), "queue", "ts", "event_id", "change", "priority",
        duplicate=key % 17 == 0, limited=key % 19 == 0,
    )
    return found.select("event_id", "depth", "effective_priority", "result", "pressure")


def _window(width: str) -> str:
    return (
        f"SELECT time_bucket(INTERVAL {width}, ts) AS window_start, event_type, count(*) AS n,"
        " CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"
    )


TUMBLING_SQL = _window("1 MINUTE")


@query("ev_tumbling", TUMBLING_SQL)
def ev_tumbling(spark, sf_dir):
    return e.tumbling_metrics(_events(spark, sf_dir), "ts", "1 minute", ["event_type"])


SLIDING_SQL = """
    SELECT w AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE) AS total
    FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * unnest([0, 1, 2]) AS w FROM events) x GROUP BY 1, 2"""


@query("ev_sliding", SLIDING_SQL)
def ev_sliding(spark, sf_dir):
    return e.sliding_metrics(_events(spark, sf_dir), "ts", "3 hours", "1 hour", ["event_type"])


@query(
    "ev_rolling_series",
    "SELECT event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS rn"
    " FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00') x WHERE rn <= 100",
)
def ev_rolling_series(spark, sf_dir):
    points = _events(spark, sf_dir).select("event_type", "ts", "value")
    return e.rolling_series(points, "event_type", "ts", datetime(2024, 1, 10), 100)


@query(
    "ev_stale_slots",
    with_fixtures(
        "SELECT slot_id, ts, user_id, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 1000000.0::DOUBLE AS age_seconds"
        " FROM slots s WHERE action = 'acquire' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3600 SECOND"
        " AND NOT EXISTS (SELECT 1 FROM slots r WHERE r.slot_id = s.slot_id AND r.action = 'release')"
    ),
)
def ev_stale_slots(spark, sf_dir):
    return e.stale_slots(fixture(spark, sf_dir, "slots"), datetime(2024, 1, 20))
