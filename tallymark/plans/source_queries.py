"""Registered source and sink queries: each writes to the shared folder what Spark derives from the tables and reads it back.

Every run has a folder of its own, so a query can be repeated at any time.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import compare, project, quality
from tallymark.operators import history as h
from tallymark.plans.compare_queries import SPEC, STATUS_CLAUSE
from tallymark.plans.fixtures import fixture, read, with_fixtures
from tallymark.plans.registry import query
from tallymark.session import fresh_path
from tallymark.sources import corpora, readers, sinks

_LINES = "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("decimal(18,2)").alias("quantity")
    )


def _database(spark: SparkSession) -> str:
    """A new database whose tables lie in the shared folder."""
    folder = fresh_path(spark)
    name = folder.rpartition("/")[2].replace("-", "_")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{folder}'")
    return name


@query("src_address", "SELECT o_orderkey, o_orderstatus FROM orders")
def src_address(spark, sf_dir):
    return readers.read_dataset(spark, f"parquet:{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")


@query("src_golden_csv", _LINES)
def src_golden_csv(spark, sf_dir):
    lines, path = _lines(spark, sf_dir), fresh_path(spark)
    lines.write.option("header", True).csv(path)
    return readers.read_golden_csv(spark, path, lines.schema)


@query("src_golden_csv_inferred", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem")
def src_golden_csv_inferred(spark, sf_dir):
    path = fresh_path(spark)
    _lines(spark, sf_dir).write.option("header", True).csv(path)
    found = readers.read_golden_csv(spark, path)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").cast("long").alias("numbers"))


@query("src_resolved_table", "SELECT s_suppkey, s_name FROM supplier")
def src_resolved_table(spark, sf_dir):
    database = _database(spark)
    sinks.replace_table(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), f"{database}.kept")
    return spark.table(readers.resolve_table(spark, "kept", default_database=database))


@query(
    "src_corpus",
    "SELECT concat('size', CAST(p_size AS VARCHAR), '.py') AS name, concat('# ', p_name, ' ', p_type) AS line FROM part WHERE p_size % 3 <> 0",
)
def src_corpus(spark, sf_dir):
    folder = fresh_path(spark)
    # Spark's writer chooses the last part of a path, so the folder names the file; files of a third of the sizes are tests.
    ending = F.when(F.col("p_size") % 3 == 0, "_test.py").otherwise(".py")
    named = read(spark, sf_dir, "part").select(
        F.concat(F.lit("size"), F.col("p_size").cast("string"), ending).alias("file"),
        F.concat(F.lit("# "), "p_name", F.lit(" "), "p_type").alias("value"),
    )
    named.write.partitionBy("file").text(folder)
    found = corpora.read_corpus(spark, [folder], include=["*.py/*"], exclude=["*_test.py/*"])
    lines = found.select(F.regexp_extract("path", r"file=([^/]+)/", 1).alias("name"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''")


@query("sink_partitioned", _LINES)
def sink_partitioned(spark, sf_dir):
    path = sinks.write_parquet(_lines(spark, sf_dir), fresh_path(spark), partition_by=["l_returnflag"])
    # A second write replaces the first.
    sinks.write_parquet(_lines(spark, sf_dir), path, partition_by=["l_returnflag"])
    return spark.read.schema(_lines(spark, sf_dir).schema).parquet(path)


@query("sink_dated_path", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-03-04'")
def sink_dated_path(spark, sf_dir):
    day = date(1997, 3, 4)
    path = sinks.dated_path(fresh_path(spark) + "/day={business_date}", day.isoformat())
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("date") == F.lit(day)).select("o_orderkey")
    sinks.write_parquet(orders, path)
    return spark.read.schema(orders.schema).parquet(path)


@query("sink_tables", f"{_LINES} UNION ALL {_LINES} WHERE l_linenumber = 1")
def sink_tables(spark, sf_dir):
    name, lines = f"{_database(spark)}.lines", _lines(spark, sf_dir)
    sinks.append_table(lines.limit(0), name)
    sinks.replace_table(lines, name)
    sinks.append_table(lines.where("l_linenumber = 1").select(*reversed(lines.columns)), name)
    return spark.table(name)


@query(
    "sink_run_log",
    with_fixtures("SELECT CAST(job_path AS VARCHAR) AS job_path, CASE WHEN request_id % 4 = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, request_id % 4 = 0 AS passed FROM runs"),
)
def sink_run_log(spark, sf_dir):
    runs = fixture(spark, sf_dir, "runs").select("job_path", (F.col("request_id") % 4).alias("findings"))
    name = f"{_database(spark)}.run_log"
    sinks.append_runs(runs, name, findings_column="findings")
    return spark.table(name).select("job_path", "status", "passed")


@query(
    "sink_diff_report",
    with_fixtures("SELECT id, status AS mismatch_type FROM joined WHERE status <> 'MATCH' ORDER BY id, status LIMIT 50", STATUS_CLAUSE),
)
def sink_diff_report(spark, sf_dir):
    diff = compare.diff_by_key(fixture(spark, sf_dir, "golden"), fixture(spark, sf_dir, "output"), SPEC)
    folder = sinks.write_diff_report(diff, ["id"], fresh_path(spark), 50)
    shown = spark.read.option("header", True).csv(f"{folder}/mismatches")
    return shown.select(F.col("id").cast("long").alias("id"), "mismatch_type")


@query(
    "sink_sums_summary",
    with_fixtures(
        "SELECT 'sums' AS mode, (SELECT count(*) FROM golden) AS left_rows, (SELECT count(*) FROM output) AS right_rows,"
        " CAST(3 AS BIGINT) AS columns, false AS passed"
    ),
)
def sink_sums_summary(spark, sf_dir):
    sides = []
    for name in ("golden", "output"):
        sides.append(f"parquet:{sinks.write_parquet(fixture(spark, sf_dir, name), fresh_path(spark))}")
    found = compare.compare_addresses(spark, *sides, SPEC, fresh_path(spark), "sums")
    return found.select("mode", "counts.left_rows", "counts.right_rows", "sums.columns", "passed")


@query("sink_tee", f"SELECT *, 'target' AS place FROM ({_LINES} UNION ALL {_LINES}) t UNION ALL SELECT *, 'copy' FROM ({_LINES}) c")
def sink_tee(spark, sf_dir):
    lines, root = _lines(spark, sf_dir), fresh_path(spark)
    capture = sinks.capture_folder(f"{root}/captured", "/jobs/load.py", "r1")
    target = f"{root}/out/lines"
    # The second write appends; its copy holds that batch only.
    if not (sinks.tee_write(lines, target, capture) and sinks.tee_write(lines, target, capture, mode="append")):
        raise RuntimeError("the copy was not made")
    written = spark.read.schema(lines.schema).parquet(target).withColumn("place", F.lit("target"))
    copied = spark.read.schema(lines.schema).parquet(f"{capture}/{sinks.capture_name(target)}")
    return written.union(copied.withColumn("place", F.lit("copy")))


@query("sink_logs", with_fixtures("SELECT log_id, CAST(ts AS DATE) AS log_date FROM logs"))
def sink_logs(spark, sf_dir):
    logs = fixture(spark, sf_dir, "logs").select("log_id", "ts")
    path = sinks.write_logs(logs, fresh_path(spark), "ts")
    return spark.read.parquet(path).select("log_id", "log_date")


@query(
    "meta_columns",
    "SELECT 'o_nothing' AS column_name, 'missing' AS finding, 'FAIL' AS status, NULL::BIGINT AS filled"
    " UNION ALL SELECT 'o_remark', 'extra', 'WARN', count(*) FROM orders WHERE o_orderstatus = 'F'",
)
def meta_columns(spark, sf_dir):
    remark = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", remark.alias("o_remark"))
    return project.validate_columns(orders, ["o_orderkey", "o_nothing"])


@query(
    "meta_name_difference",
    "SELECT 'only_left' AS side, 'o_orderkey' AS column_name, count(o_orderkey) AS filled FROM orders"
    " UNION ALL SELECT 'only_right', 'c_balance', count(*) FROM customer WHERE c_acctbal > 0",
)
def meta_name_difference(spark, sf_dir):
    left = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    right = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), balance.alias("c_balance"))
    return project.one_sided_columns(left, right)


@query(
    "meta_column_count",
    "SELECT 7 AS actual, 7 AS expected, true AS ok, count(*) AS rows,"
    " CASE WHEN count(*) FILTER (WHERE p_partkey < 0) = 0 THEN 1 ELSE 0 END AS empty_columns FROM part",
)
def meta_column_count(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return quality.column_count_check(part.withColumn("retired", F.when(F.col("p_partkey") < 0, True)), 7)


@query(
    "hist_classification_filter",
    "SELECT p_partkey AS job_id FROM part WHERE p_size < 15 AND p_partkey % 4 = 1 AND p_partkey % 3 = 0",
)
def hist_classification_filter(spark, sf_dir):
    key = F.col("job_id")
    jobs = fixture(spark, sf_dir, "classified").withColumns(
        {"batch_id": key % 4, "suggestions": F.when(key % 3 == 0, F.array(F.lit("split"))).when(key % 3 == 1, F.array().cast("array<string>"))}
    )
    return h.classification_filter(jobs, "low", 1, True).select("job_id")
