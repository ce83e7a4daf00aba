"""Registered queries over run history, logs, queues and classifications."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallymark.functions.scalars import has_all
from tallymark.operators import history as h
from tallymark.operators import project
from tallymark.operators.hierarchy import with_category_names
from tallymark.plans.fixtures import fixture, read, with_fixtures
from tallymark.plans.registry import query
from tallymark.sources.sinks import split_expired

SINCE = datetime(2024, 1, 10)
AS_OF = datetime(2024, 2, 1)
_SINCE = "TIMESTAMP '2024-01-10 00:00:00'"
_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def _mean(value: str, condition: str = "true") -> str:
    return (
        f"CASE WHEN count({value}) FILTER (WHERE {condition}) > 0 THEN"
        f" CAST(sum(CAST({value} AS DECIMAL(38,9))) FILTER (WHERE {condition}) AS DOUBLE)"
        f" / count({value}) FILTER (WHERE {condition}) END"
    )


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _age(moment: str) -> str:
    return f"(epoch_us({_AS_OF}) - epoch_us({moment})) / 1000000.0::DOUBLE"


@query(
    "hist_period_stats",
    with_fixtures(
        f"""
        SELECT count(*) AS total, {_count("status = 'completed'")} AS completed, {_count("status = 'failed'")} AS failed,
               {_count("status = 'error'")} AS errors, {_mean('duration_seconds', "status IN ('completed', 'failed')")} AS avg_duration,
               {_count("status = 'completed'")} * 100.0::DOUBLE / count(*) AS success_rate,
               ({_count("status = 'completed'")} - {_count("status = 'failed'")}) * 100.0::DOUBLE / count(*) AS net_success_rate
        FROM runs WHERE created_at >= {_SINCE}"""
    ),
)
def hist_period_stats(spark, sf_dir):
    return h.period_stats(fixture(spark, sf_dir, "runs"), SINCE)


@query(
    "hist_by_source",
    with_fixtures(f"SELECT trigger_source, count(*) AS n FROM runs WHERE created_at >= {_SINCE} GROUP BY trigger_source"),
)
def hist_by_source(spark, sf_dir):
    return h.count_by(h.since(fixture(spark, sf_dir, "runs"), "created_at", SINCE), ["trigger_source"])


@query(
    "hist_top_failing",
    with_fixtures(
        "SELECT job_path, count(*) AS n FROM runs WHERE status IN ('failed', 'error')"
        " GROUP BY job_path ORDER BY n DESC, job_path LIMIT 10"
    ),
)
def hist_top_failing(spark, sf_dir):
    return h.top_failing(fixture(spark, sf_dir, "runs"))


@query(
    "hist_common_issues",
    with_fixtures(
        f"SELECT rule_id, message, count(*) AS n FROM issues JOIN runs USING (request_id)"
        f" WHERE created_at >= {_SINCE} GROUP BY rule_id, message ORDER BY n DESC, rule_id, message LIMIT 10"
    ),
)
def hist_common_issues(spark, sf_dir):
    found = h.common_issues(fixture(spark, sf_dir, "issues"), fixture(spark, sf_dir, "runs"), SINCE)
    return found.select("rule_id", "message", "n")


_SEVERITIES = ("critical", "error", "warning", "info")


@query(
    "hist_issue_pivot",
    with_fixtures(
        "SELECT request_id, "
        + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in _SEVERITIES)
        + ", count(*) AS total FROM issues GROUP BY request_id"
    ),
)
def hist_issue_pivot(spark, sf_dir):
    return h.issue_pivot(fixture(spark, sf_dir, "issues"))


@query(
    "hist_batch_summary",
    with_fixtures(
        f"""
        SELECT batch_id, count(*) AS total, {_count("status = 'completed'")} AS completed,
               {_count("status = 'failed'")} AS failed, {_count("status = 'error'")} AS errors,
               {_count("status = 'skipped'")} AS skipped,
               {_count("status NOT IN ('completed', 'failed', 'error', 'skipped')")} AS in_progress,
               min(created_at) AS first_created, max(created_at) AS last_created,
               {_count("status = 'completed'")} * 100.0::DOUBLE / count(*) AS success_rate,
               ({_count("status = 'completed'")} - {_count("status = 'failed'")}) * 100.0::DOUBLE / count(*) AS net_success_rate
        FROM runs GROUP BY batch_id"""
    ),
)
def hist_batch_summary(spark, sf_dir):
    return h.batch_summary(fixture(spark, sf_dir, "runs"))


@query(
    "hist_batch_report",
    with_fixtures(
        f"""
        SELECT batch_id, count(*) AS total, {_count("NOT bad AND NOT warned")} AS passed,
               {_count("NOT bad AND warned")} AS warnings, {_count("bad")} AS failed,
               {_count("NOT bad")} * 100.0::DOUBLE / count(*) AS success_pct
        FROM (SELECT r.batch_id, coalesce(i.e, false) OR r.status IN ('failed', 'error') AS bad, coalesce(i.w, false) AS warned
              FROM runs r LEFT JOIN (SELECT request_id, bool_or(severity IN ('critical', 'error')) AS e,
                                            bool_or(severity = 'warning') AS w FROM issues GROUP BY request_id) i
              ON i.request_id = r.request_id) x
        GROUP BY batch_id"""
    ),
)
def hist_batch_report(spark, sf_dir):
    return h.batch_report(fixture(spark, sf_dir, "runs"), fixture(spark, sf_dir, "issues"))


@query(
    "hist_first_errors",
    with_fixtures(
        """
        SELECT r.job_path, i.request_id, i.rule_id, i.part_key, i.rn
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY stage, rule_id, message, part_key) AS rn
              FROM issues WHERE severity IN ('critical', 'error')) i
        JOIN runs r ON r.request_id = i.request_id WHERE i.rn <= 5 AND r.status IN ('failed', 'error')"""
    ),
)
def hist_first_errors(spark, sf_dir):
    found = h.first_errors(fixture(spark, sf_dir, "runs"), fixture(spark, sf_dir, "issues"))
    return found.select("job_path", "request_id", "rule_id", "part_key", F.col("rn").cast("long").alias("rn"))


@query(
    "hist_latest_per_job",
    with_fixtures(
        "SELECT job_path, request_id, status, rn FROM (SELECT *, row_number() OVER"
        " (PARTITION BY job_path ORDER BY created_at DESC, request_id) AS rn FROM runs) x WHERE rn <= 10"
    ),
)
def hist_latest_per_job(spark, sf_dir):
    found = h.latest_per_job(fixture(spark, sf_dir, "runs"), 10)
    return found.select("job_path", "request_id", "status", F.col("rn").cast("long").alias("rn"))


@query(
    "hist_recent_page",
    with_fixtures(
        "SELECT request_id, job_path, created_at FROM runs WHERE status = 'failed'"
        " ORDER BY created_at DESC, request_id LIMIT 50"
    ),
)
def hist_recent_page(spark, sf_dir):
    found = project.recent(fixture(spark, sf_dir, "runs"), "created_at", "request_id", 50, ("status", "failed"))
    return found.select("request_id", "job_path", "created_at")


@query(
    "hist_priority_queue",
    with_fixtures(
        "SELECT request_id, priority, row_number() OVER (ORDER BY priority, created_at, request_id) AS place FROM waiting WHERE status = 'pending'"
    ),
)
def hist_priority_queue(spark, sf_dir):
    rows = project.flag_filter(fixture(spark, sf_dir, "waiting"), "status", "pending")
    return project.priority_order(rows, "priority", "created_at", "request_id", "place").select("request_id", "priority", "place")


@query(
    "hist_run_trend",
    with_fixtures(
        """
        SELECT job_path, request_id, created_at, duration_seconds, CASE WHEN abs(c) >= 1 THEN c END AS change_pct
        FROM (SELECT *, (duration_seconds - p) / p * 100 AS c
              FROM (SELECT *, nullif(lag(duration_seconds) OVER (PARTITION BY job_path ORDER BY created_at, request_id), 0) AS p
                    FROM runs WHERE status = 'completed') a) b"""
    ),
)
def hist_run_trend(spark, sf_dir):
    return h.run_trend(fixture(spark, sf_dir, "runs"))


@query(
    "hist_job_trend",
    with_fixtures(
        f"""SELECT job_path, count(*) AS total, {_mean('duration_seconds', "status = 'completed'")} AS avg_duration,
            {_count("status = 'completed'")} * 100.0::DOUBLE / count(*) AS success_pct FROM runs GROUP BY job_path"""
    ),
)
def hist_job_trend(spark, sf_dir):
    return h.job_trend(fixture(spark, sf_dir, "runs"))


@query(
    "hist_estimate_accuracy",
    """
    SELECT p_partkey, abs(e) AS error_pct, abs(e) <= 10 AS is_accurate, e < 0 AS is_faster
    FROM (SELECT p_partkey, (nullif(CAST(p_size AS DOUBLE), 0) - p_retailprice / 40) / (p_retailprice / 40) * 100 AS e FROM part) x""",
)
def hist_estimate_accuracy(spark, sf_dir):
    jobs = read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("actual"), (F.col("p_retailprice") / 40).alias("estimate")
    )
    return h.estimate_accuracy(jobs, "actual", "estimate").drop("actual", "estimate")


@query(
    "hist_eta",
    with_fixtures(
        f"""
        SELECT batch_id, count(*) AS total, {_count("status <> 'running'")} AS done,
               CAST(round({_count("status <> 'running'")} * 100.0::DOUBLE / count(*)) AS INT) AS progress_pct,
               CAST(round(({_age('min(created_at)')}) / nullif({_count("status <> 'running'")}, 0)
                    * (count(*) - {_count("status <> 'running'")})) AS BIGINT) AS eta_seconds
        FROM (SELECT batch_id, created_at, CASE WHEN request_id % 3 = 0 THEN 'running' ELSE status END AS status FROM runs) x
        GROUP BY batch_id"""
    ),
)
def hist_eta(spark, sf_dir):
    runs = fixture(spark, sf_dir, "runs").withColumn(
        "status", F.when(F.col("request_id") % 3 == 0, "running").otherwise(F.col("status"))
    )
    return h.batch_eta(runs, AS_OF)


_TOTALS = (
    "count(*) AS total_count, CAST(sum(CAST(duration_seconds AS DECIMAL(38,9))) AS DOUBLE) AS total_sum,"
    f" {_mean('duration_seconds')} AS mean"
)


@query(
    "hist_histogram",
    with_fixtures(
        " UNION ALL ".join(
            [
                f"SELECT trigger_source, '{float(b)}' AS le, {_count(f'duration_seconds <= {b}')} AS bucket_count, {_TOTALS}"
                " FROM runs GROUP BY trigger_source"
                for b in h.DURATION_BUCKETS
            ]
            + [f"SELECT trigger_source, 'inf', count(*), {_TOTALS} FROM runs GROUP BY trigger_source"]
        )
    ),
)
def hist_histogram(spark, sf_dir):
    return h.histogram(fixture(spark, sf_dir, "runs"), "duration_seconds", h.DURATION_BUCKETS, ["trigger_source"])


@query(
    "hist_dashboard",
    with_fixtures(
        f"""
        SELECT count(*) AS jobs_submitted, {_count("status IN ('completed', 'failed', 'error')")} AS jobs_completed,
               {_count("status IN ('failed', 'error')")} AS jobs_failed,
               {_mean('duration_seconds', "status IN ('completed', 'failed', 'error')")} AS avg_duration,
               ({_count("status IN ('completed', 'failed', 'error')")} - {_count("status IN ('failed', 'error')")})
                   * 100.0::DOUBLE / {_count("status IN ('completed', 'failed', 'error')")} AS success_rate
        FROM runs"""
    ),
)
def hist_dashboard(spark, sf_dir):
    return h.dashboard(fixture(spark, sf_dir, "runs"))


@query(
    "hist_dashboard_rows",
    with_fixtures(
        f"""
        SELECT 'counter' AS kind, name, value FROM (
            SELECT CAST(count(*) AS DOUBLE) AS jobs_submitted,
                   CAST({_count("status IN ('completed', 'failed', 'error')")} AS DOUBLE) AS jobs_completed,
                   CAST({_count("status IN ('failed', 'error')")} AS DOUBLE) AS jobs_failed,
                   {_mean('duration_seconds', "status IN ('completed', 'failed', 'error')")} AS avg_duration,
                   ({_count("status IN ('completed', 'failed', 'error')")} - {_count("status IN ('failed', 'error')")})
                       * 100.0::DOUBLE / {_count("status IN ('completed', 'failed', 'error')")} AS success_rate
            FROM runs) UNPIVOT (value FOR name IN (jobs_submitted, jobs_completed, jobs_failed, avg_duration, success_rate))
        UNION ALL SELECT 'gauge', event_type || '_' || user_id, arg_max(value, (ts, value)) FROM events
        WHERE ts IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY event_type, user_id"""
    ),
)
def hist_dashboard_rows(spark, sf_dir):
    name = F.concat_ws("_", "event_type", "user_id")
    points = read(spark, sf_dir, "events").where("ts IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL")
    return h.dashboard_rows(fixture(spark, sf_dir, "runs"), points.select(name.alias("name"), "ts", "value"))


@query(
    "hist_gauges",
    "SELECT event_type AS name, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY event_type",
)
def hist_gauges(spark, sf_dir):
    return h.latest_gauges(read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "ts", "value"))


@query(
    "hist_queue_age",
    with_fixtures(
        f"SELECT priority, count(*) AS pending, {_age('min(created_at)')} AS oldest_age_seconds,"
        " count(*) * 100.0::DOUBLE / 500 AS utilisation_pct FROM waiting WHERE status = 'pending' GROUP BY priority"
    ),
)
def hist_queue_age(spark, sf_dir):
    return h.queue_depth(fixture(spark, sf_dir, "waiting"), AS_OF, 500)


@query(
    "hist_queue_summary",
    with_fixtures(
        f"SELECT count(*) AS pending, {_age('min(created_at)')} AS oldest_age_seconds,"
        " arg_min(priority, created_at) AS oldest_priority, count(*) * 100.0::DOUBLE / 500 AS utilisation_pct"
        " FROM waiting WHERE status = 'pending'"
    ),
)
def hist_queue_summary(spark, sf_dir):
    return h.queue_summary(fixture(spark, sf_dir, "waiting"), AS_OF, 500)


@query(
    "hist_worker_stats",
    with_fixtures(
        f"""
        SELECT worker_id, count(*) AS jobs, {_count("status = 'completed'")} AS succeeded,
               {_count("status IN ('failed', 'error')")} AS failed, {_mean('duration_seconds')} AS avg_seconds,
               CAST(grouping(worker_id) AS INT) AS is_total,
               {_count("status = 'completed'")} * 100.0::DOUBLE / count(*) AS success_rate
        FROM runs GROUP BY ROLLUP (worker_id)"""
    ),
)
def hist_worker_stats(spark, sf_dir):
    return h.worker_stats(fixture(spark, sf_dir, "runs")).withColumn("is_total", F.col("is_total").cast("int"))


@query(
    "hist_health",
    with_fixtures(
        f"""
        SELECT grp, count(*) AS components, {_count("x = 'unknown'")} AS stale,
               CASE WHEN bool_and(x = 'healthy') THEN 'healthy' WHEN bool_or(x = 'unhealthy') THEN 'unhealthy'
                    ELSE 'degraded' END AS health
        FROM (SELECT grp, CASE WHEN grp > 6 AND ({_age('checked_at')}) > 2000000 THEN 'unknown' ELSE health END AS x
              FROM components) c GROUP BY grp"""
    ),
)
def hist_health(spark, sf_dir):
    # Groups up to 6 report again just before the deadline, so only the others can be stale.
    late = F.col("grp") > 6
    reports = fixture(spark, sf_dir, "components").withColumn(
        "checked_at", F.when(late, F.col("checked_at")).otherwise(F.lit(AS_OF).cast("timestamp_ntz"))
    )
    return h.health(reports, AS_OF, 1_000_000, ["grp"])


@query(
    "hist_log_summary",
    with_fixtures(
        f"SELECT job_id, count(*) AS log_count, min(ts) AS first_log, max(ts) AS last_log,"
        f" {_count('level = ' + repr('ERROR'))} AS errors, {_count('level = ' + repr('WARNING'))} AS warnings"
        " FROM logs GROUP BY job_id"
    ),
)
def hist_log_summary(spark, sf_dir):
    return h.log_summary(fixture(spark, sf_dir, "logs"))


@query(
    "hist_stage_summary",
    with_fixtures(
        """
        SELECT job_id, stage,
               coalesce(arg_max(stage_status, ts) FILTER (WHERE stage_status IS NOT NULL), 'unknown') AS stage_status,
               arg_max(duration_seconds, ts) FILTER (WHERE duration_seconds IS NOT NULL) AS duration_seconds,
               count(*) FILTER (WHERE level IN ('ERROR', 'WARNING')) AS issues
        FROM logs WHERE stage IS NOT NULL GROUP BY job_id, stage"""
    ),
)
def hist_stage_summary(spark, sf_dir):
    return h.stage_summary(fixture(spark, sf_dir, "logs"))


@query(
    "hist_log_errors",
    with_fixtures(
        "SELECT job_id, log_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, log_id) AS rn"
        " FROM logs WHERE level = 'ERROR') x WHERE rn <= 10"
    ),
)
def hist_log_errors(spark, sf_dir):
    found = h.first_log_errors(fixture(spark, sf_dir, "logs"))
    return found.select("job_id", "log_id", F.col("rn").cast("long").alias("rn"))


@query(
    "hist_log_filter",
    with_fixtures(f"SELECT log_id, job_id FROM logs WHERE level = 'INFO' AND category = 'view' AND ts >= {_SINCE}"),
)
def hist_log_filter(spark, sf_dir):
    return h.log_filter(fixture(spark, sf_dir, "logs"), "INFO", "view", SINCE).select("log_id", "job_id")


@query(
    "hist_tag_stats",
    with_fixtures(
        """
        SELECT tag, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
               count(*) FILTER (WHERE status = 'failed') AS failed,
               count(*) FILTER (WHERE status = 'completed') * 100.0::DOUBLE / count(*) AS completion_pct
        FROM (SELECT tag1 AS tag, status FROM tagged UNION ALL SELECT tag2, status FROM tagged) t GROUP BY tag"""
    ),
)
def hist_tag_stats(spark, sf_dir):
    jobs = fixture(spark, sf_dir, "tagged").withColumn("tags", F.array("tag1", "tag2"))
    return h.tag_stats(jobs, "tags", ["completed", "failed"])


@query(
    "hist_tag_filter",
    with_fixtures("SELECT job_id FROM tagged WHERE tag1 = '1-URGENT' AND tag2 = 'cust2'"),
)
def hist_tag_filter(spark, sf_dir):
    jobs = fixture(spark, sf_dir, "tagged").withColumn("tags", F.array("tag1", "tag2"))
    return jobs.where(has_all(F.col("tags"), ["cust2", "1-URGENT"])).select("job_id")


@query(
    "hist_domain_summary",
    with_fixtures(
        """
        SELECT c.name AS domain, count(DISTINCT job_id) AS job_count,
               count(DISTINCT CASE WHEN complexity = 'low' THEN job_id END) AS low_complexity,
               count(DISTINCT CASE WHEN complexity = 'medium' THEN job_id END) AS medium_complexity,
               count(DISTINCT CASE WHEN complexity = 'high' THEN job_id END) AS high_complexity,
               CAST(sum(confidence) AS DOUBLE) / count(confidence) AS avg_confidence
        FROM classified j LEFT JOIN categories c ON c.id = j.domain_id GROUP BY c.name"""
    ),
)
def hist_domain_summary(spark, sf_dir):
    jobs = with_category_names(
        fixture(spark, sf_dir, "classified"), fixture(spark, sf_dir, "categories"), [("domain_id", "domain")]
    )
    return h.domain_summary(jobs)


@query(
    "hist_domain_counts",
    with_fixtures(
        "SELECT coalesce(c.name, 'Unclassified') AS domain, count(*) AS n FROM classified j"
        " LEFT JOIN categories c ON c.id = j.domain_id GROUP BY 1"
    ),
)
def hist_domain_counts(spark, sf_dir):
    jobs = with_category_names(
        fixture(spark, sf_dir, "classified"), fixture(spark, sf_dir, "categories"), [("domain_id", "domain")]
    )
    return h.count_by(jobs, ["domain"], "Unclassified")


@query(
    "hist_retention",
    with_fixtures(
        f"SELECT CASE WHEN created_at < {_AS_OF} - INTERVAL 15 DAY THEN 'removed' ELSE 'kept' END AS part,"
        " count(*) AS n FROM runs GROUP BY 1"
    ),
)
def hist_retention(spark, sf_dir):
    kept, removed = split_expired(fixture(spark, sf_dir, "runs"), "created_at", AS_OF, 15)
    both = kept.select(F.lit("kept").alias("part")).union(removed.select(F.lit("removed")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
