"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallymark.plans import catalogue  # noqa: E402
from tallymark.session import ship_package  # noqa: E402

HEADLINE = (
    "compare_key_diff",
    "compare_multiset",
    "compare_sums",
    "compare_group_totals",
    "dq_key_duplicates",
    "dq_column_checks",
    "dq_null_profile",
    "dq_percentiles",
    "dq_rule_errors",
    "dq_topn_drift",
    "etl_fact_build",
    "etl_sanctions",
    "etl_repayment",
    "etl_latest_rank",
    "etl_dedup",
    "etl_lookup_twice",
    "hist_common_issues",
    "hist_batch_summary",
    "hist_histogram",
    "hist_run_trend",
    "hist_first_errors",
    "tree_paths",
    "layers",
    "fuzzy_match",
    "corpus_line_rules",
    "corpus_metrics",
    "corpus_sql_statements",
    "markup_columns",
    "ev_dedup_window",
    "ev_token_bucket",
    "ev_debounce",
    "ev_admission",
    "ev_throttle",
    "ev_priority_limits",
    "lookup_three",
    "corpus_group_by",
    "corpus_documents_line_rules",
    "stream_tumbling",
    "stream_debounce",
    "stream_token_bucket",
    "stream_findings",
    "sink_partitioned",
    "sink_tee",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    known = catalogue.queries()
    # A join, an aggregate and a Python worker start before the clock does, so the first query does not pay for them.
    ship_package(spark)
    region, nation = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("region", "nation"))
    warm = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).groupBy("r_name").count()
    warm.mapInArrow(lambda batches: batches, warm.schema).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
