"""Writing results."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta
from hashlib import sha256
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.compare import sample_mismatches
from tallymark.session import stored

# Formats whose catalogs replace and append tables atomically.
_CATALOG_FORMATS = ("iceberg", "delta")

# Columns of the run log.
RUN_COLUMNS = {
    "run_timestamp": "string",
    "job_id": "string",
    "job_path": "string",
    "branch": "string",
    "worker_id": "string",
    "status": "string",
    "passed": "boolean",
    "execution_exit_code": "int",
    "execution_duration_s": "double",
    "output_path": "string",
    "golden_path": "string",
    "notes": "string",
}


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def dated_path(template: str, business_date: str) -> str:
    return template.replace("{business_date}", business_date)


def replace_table(df: DataFrame, name: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Create the table or replace its content."""
    if fmt in _CATALOG_FORMATS:
        writer = df.writeTo(name).using(fmt)
        if partition_by:
            writer = writer.partitionedBy(*[F.col(c) for c in partition_by])
        writer.createOrReplace()
    else:
        df.write.format(fmt).mode("overwrite").partitionBy(*partition_by).saveAsTable(name)


def append_table(df: DataFrame, name: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Append by column name; creates the table when it is missing."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        replace_table(df, name, fmt, partition_by)
    elif fmt in _CATALOG_FORMATS:
        df.writeTo(name).append()
    else:
        df.select(*spark.table(name).columns).write.insertInto(name)


def append_runs(runs: DataFrame, table: str, findings_column: str | None = None, fmt: str = "parquet") -> None:
    """Append run records to the run log, creating namespace and table on first use.

    Missing columns become NULL. With ``findings_column`` the status follows
    from the number of findings instead of being given.
    """
    spark = runs.sparkSession
    if "." in table:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {table.rpartition('.')[0]}")
    if findings_column:
        ok = F.coalesce(F.col(f"`{findings_column}`"), F.lit(0)) == 0
        runs = runs.withColumns({"passed": ok, "status": F.when(ok, "PASSED").otherwise("FAILED")})
    columns = [
        (F.col(f"`{name}`") if name in runs.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in RUN_COLUMNS.items()
    ]
    append_table(runs.select(*columns), table, fmt)


def write_diff_report(diff: DataFrame, keys: Sequence[str], folder: str, limit: int = 50) -> str:
    """The first findings in key order and a metric summary as CSV; only the limited report is one file.

    The findings are computed once and stored in the checkpoint folder for both.
    """
    diff = stored(diff)
    sample_mismatches(diff, keys, limit).coalesce(1).write.mode("overwrite").option("header", True).csv(
        f"{folder}/mismatches"
    )
    summary = diff.agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(
            F.array(
                F.struct(F.lit("mismatch_count").alias("metric"), F.col("n").alias("value")),
                F.struct(F.lit("sample_limit").alias("metric"), F.lit(limit).cast("long").alias("value")),
            )
        ).alias("m")
    )
    summary.select("m.*").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")
    return folder


def write_summary(summary: DataFrame, path: str) -> str:
    """A one-row summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def capture_name(target: str) -> str:
    """A folder name for the copy of a target: readable, and different for different targets."""
    readable = re.sub(r"\W+", "_", target.strip()).strip("_")[-60:]
    return f"{readable}-{sha256(target.strip().encode()).hexdigest()[:16]}"


# Where captures of a job go.
CAPTURE_LAYOUTS = {"job_request": "{root}/{job}/{request}", "job_only": "{root}/{job}", "flat": "{root}"}


def capture_folder(root: str, job_path: str, request_id: str, layout: str = "job_request") -> str:
    job = PurePosixPath(job_path).stem or "job"
    return CAPTURE_LAYOUTS[layout].format(root=root, job=job, request=request_id or "run")


def tee_write(
    df: DataFrame,
    target: str,
    capture: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    capture_format: str = "parquet",
) -> bool:
    """Write ``df`` and keep a copy of what was written under ``capture``, named by the whole target.

    Both writes read one stored result, so the plan of ``df`` runs once and the
    copy holds this batch only, also when the target is appended to. A failed
    copy never fails the job; the result tells whether the copy was made.
    """
    batch = stored(df)
    batch.write.format(fmt).mode(mode).save(target)
    try:
        writer = batch.write.mode("overwrite")
        if capture_format == "csv":
            writer = writer.option("header", True)
        writer.format(capture_format).save(f"{capture}/{capture_name(target)}")
        return True
    except Exception:
        return False


def write_logs(logs: DataFrame, path: str, moment: str = "timestamp", max_rows: int = 1_000_000) -> str:
    """Append log records partitioned by day, compressed, in files of bounded size."""
    (
        logs.withColumn("log_date", F.to_date(F.col(f"`{moment}`")))
        .write.mode("append")
        .partitionBy("log_date")
        .option("maxRecordsPerFile", max_rows)
        .option("compression", "gzip")
        .parquet(path)
    )
    return path


def split_expired(df: DataFrame, moment: str, as_of: date, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows older than ``days`` before ``as_of``; rows without a time stay."""
    cutoff = F.lit(as_of - timedelta(days=days)).cast(df.schema[moment].dataType)
    old = F.coalesce(F.col(f"`{moment}`") < cutoff, F.lit(False))
    return df.where(~old), df.where(old)


def drop_expired_partitions(spark: SparkSession, table: str, column: str, as_of: date, days: int) -> list[str]:
    """Drop the day partitions older than ``days``; only partition names are listed. Returns the dropped days."""
    cutoff = (as_of - timedelta(days=days)).isoformat()
    listed = spark.sql(f"SHOW PARTITIONS {table}").select(
        F.regexp_extract("partition", rf"{re.escape(column)}=([^/]+)", 1).alias("day")
    )
    expired = [r.day for r in listed.where(F.col("day") < cutoff).distinct().orderBy("day").collect()]
    for day in expired:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = '{day}')")
    return expired
