"""Registered comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import compare
from tallymark.plans.fixtures import fixture, read, with_fixtures
from tallymark.plans.registry import query
from tallymark.specs import CompareSpec

SPEC = CompareSpec(keys=("id",), tolerance="0.01")
_VALUES = ("o_custkey", "o_orderstatus", "amount", "order_date", "o_orderpriority")

STATUS_CLAUSE = """
    joined AS (
        SELECT coalesce(g.id, o.id) AS id,
               CASE WHEN o.id IS NULL THEN 'MISSING_IN_OUTPUT' WHEN g.id IS NULL THEN 'EXTRA_IN_OUTPUT'
                    WHEN g.o_custkey IS DISTINCT FROM o.o_custkey
                      OR g.o_orderstatus IS DISTINCT FROM o.o_orderstatus
                      OR NOT (coalesce(abs(g.amount - o.amount) <= 0.01, false)
                              OR g.amount IS NOT DISTINCT FROM o.amount)
                      OR g.order_date IS DISTINCT FROM o.order_date
                      OR g.o_orderpriority IS DISTINCT FROM o.o_orderpriority THEN 'VALUE_MISMATCH'
                    ELSE 'MATCH' END AS status,
               g.o_custkey AS g1, g.o_orderstatus AS g2, g.amount AS g3, g.order_date AS g4, g.o_orderpriority AS g5,
               o.o_custkey AS o1, o.o_orderstatus AS o2, o.amount AS o3, o.order_date AS o4, o.o_orderpriority AS o5
        FROM golden g FULL JOIN output o ON g.id = o.id)"""


def _sides(spark, sf_dir):
    return fixture(spark, sf_dir, "golden"), fixture(spark, sf_dir, "output")


@query(
    "compare_key_diff",
    with_fixtures(
        "SELECT id, status AS mismatch_type, "
        + ", ".join(
            f"CASE WHEN status = 'VALUE_MISMATCH' THEN CAST({side[0]}{i} AS VARCHAR) END AS {side}__{c}"
            for side in ("golden", "output")
            for i, c in enumerate(_VALUES, 1)
        )
        + " FROM joined WHERE status <> 'MATCH'",
        STATUS_CLAUSE,
    ),
)
def compare_key_diff(spark, sf_dir):
    return compare.diff_by_key(*_sides(spark, sf_dir), SPEC)


@query(
    "compare_key_status_counts",
    with_fixtures("SELECT status, count(*) AS n FROM joined GROUP BY status", STATUS_CLAUSE),
)
def compare_key_status_counts(spark, sf_dir):
    return compare.status_counts(compare.pair_by_key(*_sides(spark, sf_dir), SPEC))


@query(
    "compare_column_mismatch",
    with_fixtures(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE status IN ('MATCH', 'VALUE_MISMATCH') AND "
            + (
                f"NOT (coalesce(abs(g{i} - o{i}) <= 0.01, false) OR g{i} IS NOT DISTINCT FROM o{i})"
                if c == "amount"
                else f"g{i} IS DISTINCT FROM o{i}"
            )
            + ") AS mismatches FROM joined"
            for i, c in enumerate(_VALUES, 1)
        ),
        STATUS_CLAUSE,
    ),
)
def compare_column_mismatch(spark, sf_dir):
    return compare.column_mismatches(compare.pair_by_key(*_sides(spark, sf_dir), SPEC), _VALUES)


@query(
    "compare_sample_mismatches",
    with_fixtures(
        "SELECT id, status AS mismatch_type FROM joined WHERE status <> 'MATCH' ORDER BY id, status LIMIT 50",
        STATUS_CLAUSE,
    ),
)
def compare_sample_mismatches(spark, sf_dir):
    diff = compare.diff_by_key(*_sides(spark, sf_dir), SPEC)
    return compare.sample_mismatches(diff, ["id"], 50).select("id", "mismatch_type")


@query(
    "compare_summary",
    with_fixtures(
        "SELECT 'keys' AS mode, (SELECT count(*) FROM golden) AS left_rows, (SELECT count(*) FROM output) AS right_rows,"
        " count(*) FILTER (WHERE status = 'MISSING_IN_OUTPUT') AS missing_keys,"
        " count(*) FILTER (WHERE status = 'EXTRA_IN_OUTPUT') AS extra_keys,"
        " count(*) FILTER (WHERE status = 'VALUE_MISMATCH') AS changed_keys,"
        " count(*) FILTER (WHERE status <> 'MATCH') = 0 AS passed FROM joined",
        STATUS_CLAUSE,
    ),
)
def compare_summary(spark, sf_dir):
    return compare.compare_summary(*_sides(spark, sf_dir), SPEC).select(
        "mode", "counts.*", "diff.missing_keys", "diff.extra_keys", "diff.changed_keys", "passed"
    )


@query(
    "compare_quality_report",
    with_fixtures(
        """
        SELECT 'orders' AS dataset_name, (SELECT count(*) FROM golden) AS row_count_left,
               (SELECT count(*) FROM output) AS row_count_right, CAST(0 AS BIGINT) AS key_duplicate_count,
               (SELECT count(*) FILTER (WHERE o_orderpriority IS NULL) / CAST(count(*) AS DOUBLE) FROM output)
                   AS priority_null_rate,
               count(*) FILTER (WHERE status IN ('MATCH', 'VALUE_MISMATCH') AND g2 IS DISTINCT FROM o2)
                   AS status_mismatches
        FROM joined""",
        STATUS_CLAUSE,
    ),
)
def compare_quality_report(spark, sf_dir):
    report = compare.quality_report("orders", *_sides(spark, sf_dir), SPEC)
    rate = F.filter("null_rate_summary", lambda x: x["column_name"] == "o_orderpriority")
    worst = F.filter("top_mismatch_columns", lambda x: x["column_name"] == "o_orderstatus")
    return report.select(
        "dataset_name",
        "row_count_left",
        "row_count_right",
        "key_duplicate_count",
        F.get(rate, F.lit(0))["null_rate"].alias("priority_null_rate"),
        F.get(worst, F.lit(0))["mismatches"].alias("status_mismatches"),
    )


@query(
    "compare_multiset",
    with_fixtures(
        """
        SELECT l_orderkey, l_linenumber, l_partkey, quantity, l_returnflag,
               CAST(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS BIGINT) AS golden_count,
               CAST(sum(CASE WHEN w < 0 THEN 1 ELSE 0 END) AS BIGINT) AS output_count
        FROM (SELECT *, 1 AS w FROM lines_golden UNION ALL SELECT *, -1 FROM lines_output) b
        GROUP BY ALL HAVING sum(w) <> 0"""
    ),
)
def compare_multiset(spark, sf_dir):
    return compare.diff_multiset(fixture(spark, sf_dir, "lines_golden"), fixture(spark, sf_dir, "lines_output"))


@query(
    "compare_duplicate_keys",
    with_fixtures(
        """
        SELECT mismatch_type, count(*) AS n FROM (
            SELECT 'DUPLICATE_KEY_GOLDEN' AS mismatch_type FROM lines_golden
            GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
            UNION ALL
            SELECT 'DUPLICATE_KEY_OUTPUT' FROM lines_output GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
        ) d GROUP BY mismatch_type"""
    ),
)
def compare_duplicate_keys(spark, sf_dir):
    spec = CompareSpec(keys=("l_orderkey", "l_linenumber"))
    diff = compare.diff_by_key(
        fixture(spark, sf_dir, "lines_golden"), fixture(spark, sf_dir, "lines_output"), spec
    )
    return (
        diff.where(F.col("mismatch_type").startswith("DUPLICATE_KEY"))
        .groupBy("mismatch_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "compare_anti_left",
    with_fixtures("SELECT * FROM golden g WHERE NOT EXISTS (SELECT 1 FROM output o WHERE o.id = g.id)"),
)
def compare_anti_left(spark, sf_dir):
    golden, output = _sides(spark, sf_dir)
    return compare.rows_without_partner(golden, output, ["id"])


@query(
    "compare_anti_right",
    with_fixtures("SELECT * FROM output o WHERE NOT EXISTS (SELECT 1 FROM golden g WHERE o.id = g.id)"),
)
def compare_anti_right(spark, sf_dir):
    golden, output = _sides(spark, sf_dir)
    return compare.rows_without_partner(output, golden, ["id"])


@query(
    "compare_sums",
    with_fixtures(
        " UNION ALL ".join(
            f"""
            SELECT '{c}' AS column_name, l AS left_sum, r AS right_sum, CAST(l - r AS DECIMAL(38,2)) AS delta,
                   abs(l - r) <= 1000 AS ok
            FROM (SELECT (SELECT CAST(sum(CAST({c} AS DECIMAL(38,2))) AS DECIMAL(38,2)) FROM golden) AS l,
                         (SELECT CAST(sum(CAST({c} AS DECIMAL(38,2))) AS DECIMAL(38,2)) FROM output) AS r) s"""
            for c in ("id", "o_custkey", "amount")
        )
    ),
)
def compare_sums(spark, sf_dir):
    return compare.reconcile_sums(*_sides(spark, sf_dir), tolerance=1000)


@query(
    "compare_group_totals",
    with_fixtures(
        """
        SELECT o_orderpriority, CAST(sum(l) AS BIGINT) AS left_rows, CAST(sum(r) AS BIGINT) AS right_rows,
               CAST(sum(la) AS DECIMAL(38,2)) AS left_total, CAST(sum(ra) AS DECIMAL(38,2)) AS right_total,
               CAST(coalesce(sum(la), 0) - coalesce(sum(ra), 0) AS DECIMAL(38,2)) AS delta,
               abs(coalesce(sum(la), 0) - coalesce(sum(ra), 0)) <= 0.01
                   AND (sum(la) IS NULL) = (sum(ra) IS NULL) AS ok
        FROM (SELECT o_orderpriority, 1 AS l, 0 AS r, CAST(amount AS DECIMAL(38,2)) AS la,
                     CAST(NULL AS DECIMAL(38,2)) AS ra FROM golden
              UNION ALL
              SELECT o_orderpriority, 0, 1, NULL, CAST(amount AS DECIMAL(38,2)) FROM output) b
        GROUP BY o_orderpriority"""
    ),
)
def compare_group_totals(spark, sf_dir):
    return compare.group_totals(*_sides(spark, sf_dir), ["o_orderpriority"], "amount", "0.01")


@query(
    "compare_counts",
    with_fixtures(
        "SELECT l AS left_rows, r AS right_rows, abs(l - r) <= l * 0.01 AS ok FROM"
        " (SELECT (SELECT count(*) FROM golden) AS l, (SELECT count(*) FROM output) AS r) c"
    ),
)
def compare_counts(spark, sf_dir):
    return compare.compare_counts(*_sides(spark, sf_dir), 0.01)


@query(
    "compare_expected_counts",
    with_fixtures(
        "SELECT 'golden' AS dataset, count(*) AS actual, CAST(100 AS BIGINT) AS expected,"
        " CASE WHEN count(*) <> 100 THEN 'MISMATCH' ELSE 'OK' END AS status FROM golden"
        " UNION ALL SELECT 'output', count(*), NULL, CASE WHEN count(*) = 0 THEN 'EMPTY' ELSE 'OK' END FROM output"
        " UNION ALL SELECT 'none', count(*), NULL, CASE WHEN count(*) = 0 THEN 'EMPTY' ELSE 'OK' END"
        " FROM golden WHERE id < 0"
    ),
)
def compare_expected_counts(spark, sf_dir):
    golden, output = _sides(spark, sf_dir)
    none = golden.where(F.col("id") < 0)
    return compare.check_counts({"golden": golden, "output": output, "none": none}, {"golden": 100})


@query(
    "compare_audit_columns",
    """
    SELECT mismatch_type, count(*) AS n FROM (
        SELECT CASE WHEN date_trunc('day', ts) IS DISTINCT FROM date_trunc('day', ts + INTERVAL 1 HOUR) THEN 'VALUE_MISMATCH' END AS mismatch_type
        FROM events) x
    WHERE mismatch_type IS NOT NULL GROUP BY mismatch_type""",
)
def compare_audit_columns(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "ts", "value", "props")
    reloaded = events.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 HOUR"), "props": F.lit("other")})
    sides = [compare.audit_normalised(df, blank=["props"], to_day=["ts"]) for df in (events, reloaded)]
    diff = compare.diff_by_key(*sides, CompareSpec(keys=("event_id",)))
    return diff.groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "compare_text_golden",
    with_fixtures(
        """
        SELECT mismatch_type, count(*) AS n FROM (
            SELECT CASE WHEN o.id IS NULL THEN 'MISSING_IN_OUTPUT' WHEN g.id IS NULL THEN 'EXTRA_IN_OUTPUT'
                        WHEN g.id % 71 = 0 THEN 'TYPE_ERROR' WHEN g.amount <> o.amount THEN 'VALUE_MISMATCH' END AS mismatch_type
            FROM golden g FULL JOIN output o ON g.id = o.id) x
        WHERE mismatch_type IS NOT NULL GROUP BY mismatch_type"""
    ),
)
def compare_text_golden(spark, sf_dir):
    golden, output = _sides(spark, sf_dir)
    amount = F.when(F.col("id") % 71 == 0, "n/a").otherwise(F.col("amount").cast("string"))
    as_text = golden.select(F.col("id").cast("string").alias("id"), amount.alias("amount"))
    diff = compare.diff_by_key(as_text, output.select("id", "amount"), CompareSpec(keys=("id",)))
    return diff.groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n"))
