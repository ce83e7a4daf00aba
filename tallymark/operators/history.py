"""Statistics over validation runs, issues, logs, queues and workers.

Runs have ``request_id, job_path, trigger_source, priority, status,
created_at, duration_seconds``; issues refer to them by ``request_id``. Every
moment that means "now" is a parameter. Means come from exact decimal sums, so
they do not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import age_seconds, estimate_error_pct, remaining_seconds
from tallymark.operators.project import top_k_by_count
from tallymark.operators.shape import exact_parts, exact_sum, rows_from
from tallymark.operators.windows import first_n_per_key, with_previous

FINISHED = ("completed", "failed")

# Bucket limits of the duration histograms.
DEFAULT_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
DURATION_BUCKETS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)


def exact_mean(value: Column, condition: Column | None = None) -> Column:
    chosen = value if condition is None else F.when(condition, value)
    return F.try_divide(exact_sum(chosen), F.count(chosen))


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def since(df: DataFrame, moment: str, start: datetime | None) -> DataFrame:
    return df if start is None else df.where(F.col(f"`{moment}`") >= F.lit(start).cast(df.schema[moment].dataType))


def status_is(*names: str) -> Column:
    return F.col("status").isin(*names)


# --- runs ------------------------------------------------------------------


def period_stats(runs: DataFrame, start: datetime | None = None) -> DataFrame:
    """Totals of a period. ``success_rate`` is completed of total; ``net_success_rate`` also subtracts failures."""
    counted = since(runs, "created_at", start).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status_is("completed")).alias("completed"),
        F.count_if(status_is("failed")).alias("failed"),
        F.count_if(status_is("error")).alias("errors"),
        exact_mean(F.col("duration_seconds"), status_is(*FINISHED)).alias("avg_duration"),
    )
    return counted.select(
        "*",
        pct(F.col("completed"), F.col("total")).alias("success_rate"),
        pct(F.col("completed") - F.col("failed"), F.col("total")).alias("net_success_rate"),
    )


def count_by(df: DataFrame, columns: Sequence[str], missing: str | None = None) -> DataFrame:
    """Rows per value combination; ``missing`` replaces NULL."""
    named = [
        (F.coalesce(F.col(f"`{c}`"), F.lit(missing)) if missing is not None else F.col(f"`{c}`")).alias(c)
        for c in columns
    ]
    return df.groupBy(*named).agg(F.count(F.lit(1)).alias("n"))


def top_failing(runs: DataFrame, start: datetime | None = None, k: int = 10) -> DataFrame:
    return top_k_by_count(since(runs, "created_at", start).where(status_is("failed", "error")), ["job_path"], k)


def common_issues(issues: DataFrame, runs: DataFrame, start: datetime | None = None, k: int = 10) -> DataFrame:
    """Most frequent rule and message pairs of a period.

    Issues are counted per request, rule and message before they meet the
    runs, so a request with very many issues is one row in the join.
    """
    counted = (
        issues.where(F.col("rule_id").isNotNull())
        .groupBy("request_id", "rule_id", "message")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_period = since(runs, "created_at", start).select("request_id")
    return (
        counted.join(in_period, "request_id")
        .groupBy("rule_id", "message")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "rule_id", "message")
        .limit(k)
    )


def issue_pivot(issues: DataFrame, severities: Sequence[str] = ("critical", "error", "warning", "info")) -> DataFrame:
    """Issues per request and severity, zero where there are none."""
    return issues.groupBy("request_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in severities], F.count(F.lit(1)).alias("total")
    )


def batch_summary(runs: DataFrame) -> DataFrame:
    done = status_is("completed", "failed", "error", "skipped")
    return (
        runs.groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(status_is("completed")).alias("completed"),
            F.count_if(status_is("failed")).alias("failed"),
            F.count_if(status_is("error")).alias("errors"),
            F.count_if(status_is("skipped")).alias("skipped"),
            F.count_if(~F.coalesce(done, F.lit(False))).alias("in_progress"),
            F.min("created_at").alias("first_created"),
            F.max("created_at").alias("last_created"),
        )
        .withColumns(
            {
                "success_rate": pct(F.col("completed"), F.col("total")),
                "net_success_rate": pct(F.col("completed") - F.col("failed"), F.col("total")),
            }
        )
    )


def batch_report(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Per batch: runs passed, passed with warnings only, failed, and the share that succeeded."""
    worst = issues.groupBy("request_id").agg(
        F.bool_or(F.col("severity").isin("critical", "error")).alias("has_errors"),
        F.bool_or(F.col("severity") == "warning").alias("has_warnings"),
    )
    errors = F.coalesce("has_errors", F.lit(False)) | status_is("failed", "error")
    warned = F.coalesce("has_warnings", F.lit(False))
    return (
        runs.join(worst, "request_id", "left")
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(~errors & ~warned).alias("passed"),
            F.count_if(~errors & warned).alias("warnings"),
            F.count_if(errors).alias("failed"),
        )
        .withColumn("success_pct", pct(F.col("passed") + F.col("warnings"), F.col("total")))
    )


def first_errors(runs: DataFrame, issues: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` errors of every failed run, in (rule, message, part) order."""
    failed = runs.where(status_is("failed", "error")).select("request_id", "job_path")
    bad = issues.where(F.col("severity").isin("critical", "error"))
    order = [F.asc(c) for c in bad.columns if c not in ("request_id", "severity")]
    limited = first_n_per_key(bad, ["request_id"], order, n)
    return limited.join(failed, "request_id")


def latest_per_job(runs: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` runs per job."""
    return first_n_per_key(runs, ["job_path"], [F.desc("created_at"), F.asc("request_id")], n)


def run_trend(runs: DataFrame, slices: int | None = None) -> DataFrame:
    """Duration change of each completed run against the run before, in percent; changes below 1 % are NULL."""
    completed = runs.where(status_is("completed") & F.col("duration_seconds").isNotNull())
    before = with_previous(completed, ["job_path"], "created_at", "request_id", ["duration_seconds"], slices)
    previous = F.nullif(F.col("previous_duration_seconds"), F.lit(0.0))
    change = F.try_divide(F.col("duration_seconds") - previous, previous) * 100
    return before.select(
        "job_path",
        "request_id",
        "created_at",
        "duration_seconds",
        F.when(F.abs(change) >= 1, change).alias("change_pct"),
    )


def job_trend(runs: DataFrame) -> DataFrame:
    return runs.groupBy("job_path").agg(
        F.count(F.lit(1)).alias("total"),
        exact_mean(F.col("duration_seconds"), status_is("completed")).alias("avg_duration"),
        pct(F.count_if(status_is("completed")), F.count(F.lit(1))).alias("success_pct"),
    )


def estimate_accuracy(df: DataFrame, actual: str, estimate: str) -> DataFrame:
    """Relative estimate error, whether it is within 10 % and whether the work was faster."""
    a = F.nullif(F.col(f"`{actual}`"), F.lit(0.0))
    e = F.nullif(F.col(f"`{estimate}`"), F.lit(0.0))
    error = estimate_error_pct(a, e)
    return df.withColumns(
        {"error_pct": F.abs(error), "is_accurate": F.abs(error) <= 10, "is_faster": error < 0}
    )


def batch_eta(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Progress and remaining seconds per batch at its average pace."""
    done = status_is("completed", "failed", "error", "skipped")
    counted = runs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(done, F.lit(False))).alias("done"),
        F.min("created_at").alias("started"),
    )
    elapsed = age_seconds(F.col("started"), F.lit(as_of).cast("timestamp"))
    return counted.select(
        "batch_id",
        "total",
        "done",
        F.round(pct(F.col("done"), F.col("total"))).cast("int").alias("progress_pct"),
        F.round(remaining_seconds(elapsed, F.col("done"), F.col("total"))).cast("long").alias("eta_seconds"),
    )


# --- metrics ---------------------------------------------------------------


def histogram(df: DataFrame, value: str, buckets: Sequence[float] = DEFAULT_BUCKETS, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets (``value <= le``) plus ``inf``, with count, sum and mean, in one pass."""
    v = F.col(f"`{value}`")
    named = [F.col(f"`{c}`") for c in by]
    counted = df.where(v.isNotNull()).groupBy(*named).agg(
        *[F.count_if(v <= F.lit(float(b))).alias(f"__{i}") for i, b in enumerate(buckets)],
        F.count(F.lit(1)).alias("__n"),
        exact_sum(v).alias("__sum"),
    )
    total, amount = F.col("__n"), F.col("__sum")

    def row(limit: str, count: Column) -> dict[str, Column]:
        return {
            "le": F.lit(limit),
            "bucket_count": count,
            "total_count": total,
            "total_sum": F.coalesce(amount, F.lit(0.0)),
            "mean": F.coalesce(F.try_divide(amount, total), F.lit(0.0)),
        }

    listed = [row(str(float(b)), F.col(f"__{i}")) for i, b in enumerate(buckets)] + [row("inf", total)]
    return rows_from(counted, listed, keep=list(by))


def dashboard(runs: DataFrame, gauges: DataFrame | None = None) -> DataFrame:
    """Counters of the run table and the latest value of each gauge (rows of ``name, ts, value``)."""
    finished = status_is("completed", "failed", "error")
    summary = runs.agg(
        F.count(F.lit(1)).alias("jobs_submitted"),
        F.count_if(finished).alias("jobs_completed"),
        F.count_if(status_is("failed", "error")).alias("jobs_failed"),
        exact_mean(F.col("duration_seconds"), finished).alias("avg_duration"),
    ).withColumn(
        "success_rate", pct(F.col("jobs_completed") - F.col("jobs_failed"), F.col("jobs_completed"))
    )
    if gauges is None:
        return summary
    latest = latest_gauges(gauges).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("g"))
    return summary.withColumn("gauges", latest.scalar())


def dashboard_rows(runs: DataFrame, gauges: DataFrame) -> DataFrame:
    """The dashboard as rows of ``kind, name, value``: counters of the run table, and every gauge at its latest, however many there are."""
    summary = dashboard(runs)
    counters = [{"kind": F.lit("counter"), "name": F.lit(c), "value": F.col(c).cast("double")} for c in summary.columns]
    latest = latest_gauges(gauges).select(F.lit("gauge").alias("kind"), "name", F.col("value").cast("double").alias("value"))
    return rows_from(summary, counters).union(latest)


def latest_gauges(points: DataFrame) -> DataFrame:
    """Last value of each gauge; a gauge is a named series, so the result has one row per name."""
    return points.groupBy("name").agg(
        F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts")
    )


def queue_depth(requests: DataFrame, as_of: datetime, capacity: int) -> DataFrame:
    """Pending requests per priority, the age of the oldest and the share of the capacity."""
    waiting = requests.where(status_is("pending")).groupBy("priority").agg(
        F.count(F.lit(1)).alias("pending"), F.min("created_at").alias("oldest")
    )
    return waiting.select(
        "priority",
        "pending",
        age_seconds(F.col("oldest"), F.lit(as_of).cast("timestamp")).alias("oldest_age_seconds"),
        pct(F.col("pending"), F.lit(capacity)).alias("utilisation_pct"),
    )


def queue_summary(requests: DataFrame, as_of: datetime, capacity: int) -> DataFrame:
    """All priorities together: depth, oldest request and its priority."""
    oldest = F.min(F.struct("created_at", "priority", "request_id"))
    found = requests.where(status_is("pending")).agg(F.count(F.lit(1)).alias("pending"), oldest.alias("o"))
    return found.select(
        "pending",
        age_seconds(F.col("o.created_at"), F.lit(as_of).cast("timestamp")).alias("oldest_age_seconds"),
        F.col("o.priority").alias("oldest_priority"),
        pct(F.col("pending"), F.lit(capacity)).alias("utilisation_pct"),
    )


def worker_stats(runs: DataFrame) -> DataFrame:
    """Jobs, successes, failures, mean seconds and success rate per worker and, with worker NULL, in total."""
    ok, bad = status_is("completed"), status_is("failed", "error")
    return (
        runs.rollup("worker_id")
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.count_if(ok).alias("succeeded"),
            F.count_if(bad).alias("failed"),
            exact_mean(F.col("duration_seconds")).alias("avg_seconds"),
            F.grouping("worker_id").alias("is_total"),
        )
        .withColumn("success_rate", pct(F.col("succeeded"), F.col("jobs")))
    )


def health(components: DataFrame, as_of: datetime, interval_seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """Overall health: healthy if all are, unhealthy if any is, else degraded; stale reports count as unknown."""
    age = age_seconds(F.col("checked_at"), F.lit(as_of).cast("timestamp"))
    fresh = F.when(age > F.lit(2.0 * interval_seconds), "unknown").otherwise(F.col("health"))
    return (
        components.withColumn("__h", fresh)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("components"),
            F.count_if(F.col("__h") == "unknown").alias("stale"),
            F.when(F.bool_and(F.col("__h") == "healthy"), "healthy")
            .when(F.bool_or(F.col("__h") == "unhealthy"), "unhealthy")
            .when(F.count(F.lit(1)) == 0, "unknown")
            .otherwise("degraded")
            .alias("health"),
        )
    )


# --- logs ------------------------------------------------------------------


def log_summary(logs: DataFrame) -> DataFrame:
    """Per job: first and last time, number of records, warnings and errors."""
    return logs.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("log_count"),
        F.min("ts").alias("first_log"),
        F.max("ts").alias("last_log"),
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.count_if(F.col("level") == "WARNING").alias("warnings"),
    )


def stage_summary(logs: DataFrame) -> DataFrame:
    """Per job and stage: last known status and duration and the number of warnings and errors."""
    order = F.struct("ts", "log_id")

    def last(column: str) -> Column:
        return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order))

    return (
        logs.where(F.col("stage").isNotNull())
        .groupBy("job_id", "stage")
        .agg(
            F.coalesce(last("stage_status"), F.lit("unknown")).alias("stage_status"),
            last("duration_seconds").alias("duration_seconds"),
            F.count_if(F.col("level").isin("ERROR", "WARNING")).alias("issues"),
        )
    )


def first_log_errors(logs: DataFrame, n: int = 10) -> DataFrame:
    return first_n_per_key(
        logs.where(F.col("level") == "ERROR"), ["job_id"], [F.asc("ts"), F.asc("log_id")], n
    )


def log_filter(logs: DataFrame, level: str | None = None, category: str | None = None, start: datetime | None = None) -> DataFrame:
    rows = since(logs, "ts", start)
    if level is not None:
        rows = rows.where(F.col("level") == level)
    if category is not None:
        rows = rows.where(F.col("category") == category)
    return rows


# --- classifications -------------------------------------------------------


def classification_filter(
    jobs: DataFrame,
    complexity: str | None = None,
    batch: int | str | None = None,
    has_suggestions: bool | None = None,
    suggestions: str = "suggestions",
) -> DataFrame:
    """Classified jobs by any of complexity, batch and whether they carry suggestions (an array or its absence)."""
    rows = jobs
    if complexity is not None:
        rows = rows.where(F.col("complexity") == complexity)
    if batch is not None:
        rows = rows.where(F.col("batch_id") == F.lit(batch))
    if has_suggestions is not None:
        some = F.coalesce(F.size(F.col(f"`{suggestions}`")) > 0, F.lit(False))
        rows = rows.where(some if has_suggestions else ~some)
    return rows


def tag_stats(jobs: DataFrame, tags: str = "tags", statuses: Sequence[str] = ("completed", "failed", "error")) -> DataFrame:
    """Jobs per tag, per status, and the completed share."""
    return (
        jobs.select(F.explode(F.array_distinct(F.col(f"`{tags}`"))).alias("tag"), "status")
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("total"), *[F.count_if(status_is(s)).alias(s) for s in statuses])
        .withColumn("completion_pct", pct(F.col(statuses[0]), F.col("total")))
    )


def domain_summary(jobs: DataFrame) -> DataFrame:
    """Distinct jobs per domain and complexity and the mean confidence.

    Rows are first reduced to one per (domain, job), which replaces four
    distinct aggregates by one shuffle on a key that no domain can skew.
    """
    level = F.col("complexity")
    high, low = exact_parts(F.col("confidence"))
    per_job = jobs.groupBy("domain", "job_id").agg(
        *[
            F.max(F.when((level == s) & F.col("job_id").isNotNull(), 1).otherwise(0)).alias(s)
            for s in ("low", "medium", "high")
        ],
        F.sum(high).alias("conf"),
        F.sum(low).alias("conf_rest"),
        F.count(high).alias("n"),
    )
    return per_job.groupBy("domain").agg(
        F.count(F.col("job_id")).alias("job_count"),
        *[F.sum(s).alias(f"{s}_complexity") for s in ("low", "medium", "high")],
        F.try_divide(F.sum("conf").cast("double") + F.sum("conf_rest").cast("double"), F.sum("n")).alias("avg_confidence"),
    )
