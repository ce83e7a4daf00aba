"""Registered data-quality queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallymark.operators import quality as q
from tallymark.plans.fixtures import fixture, read, run_sql, with_fixtures
from tallymark.plans.registry import query
from tallymark.specs import Rule
from tallymark.streaming.events import split_by_rules


@query(
    "dq_key_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def dq_key_duplicates(spark, sf_dir):
    return q.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dq_key_nulls",
    with_fixtures(
        "SELECT count(*) AS row_count,"
        " count(*) FILTER (WHERE c_mktsegment IS NULL OR c_acctbal IS NULL) AS null_keys FROM customers"
    ),
)
def dq_key_nulls(spark, sf_dir):
    return q.key_nulls(fixture(spark, sf_dir, "customers"), ["c_mktsegment", "c_acctbal"])


@query(
    "dq_null_profile",
    with_fixtures(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS nulls,"
            f" (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_pct FROM customers"
            for c in ("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
        )
    ),
)
def dq_null_profile(spark, sf_dir):
    return q.null_profile(fixture(spark, sf_dir, "customers"))


_CHECKS = (
    ("range", "l_quantity", "l_quantity < 2 OR l_quantity > 45"),
    ("range", "l_discount", "l_discount > 0.05"),
    ("allowed", "l_returnflag", "l_returnflag NOT IN ('A', 'N')"),
    ("future_date", "l_shipdate", "l_shipdate > TIMESTAMP '2000-01-01 00:00:00'"),
    ("format", "l_linestatus", "NOT regexp_matches(l_linestatus, '^[OX]$')"),
    ("not_null", "l_tax", "l_tax IS NULL"),
)


@query(
    "dq_column_checks",
    " UNION ALL ".join(
        f"SELECT '{k}' AS check_name, '{c}' AS column_name, count(*) AS row_count,"
        f" count(*) FILTER (WHERE {bad}) AS violations, count(*) FILTER (WHERE {bad}) = 0 AS passed FROM lineitem"
        for k, c, bad in _CHECKS
    ),
)
def dq_column_checks(spark, sf_dir):
    return q.run_checks(
        read(spark, sf_dir, "lineitem"),
        [
            q.in_range("l_quantity", 2, 45),
            q.in_range("l_discount", high=0.05),
            q.one_of("l_returnflag", ["A", "N"]),
            q.not_after("l_shipdate", datetime(2000, 1, 1)),
            q.matches("l_linestatus", "^[OX]$"),
            q.not_null("l_tax"),
        ],
    )


@query(
    "dq_reference_values",
    "SELECT l_partkey AS key_value, count(*) AS n FROM lineitem"
    " WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey",
)
def dq_reference_values(spark, sf_dir):
    allowed = read(spark, sf_dir, "part").where("p_size > 10")
    return q.not_in_reference(read(spark, sf_dir, "lineitem"), "l_partkey", allowed, "p_partkey")


@query(
    "dq_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM lineitem"
        for c in ("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
    ),
)
def dq_distinct(spark, sf_dir):
    return q.distinct_counts(
        read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"]
    )


@query(
    "dq_percentiles",
    " UNION ALL ".join(
        f"SELECT CAST({f} AS DOUBLE) AS fraction, round(quantile_cont(l_extendedprice, {f}), 4) AS value FROM lineitem"
        for f in (0.01, 0.25, 0.5, 0.9, 0.99)
    ),
)
def dq_percentiles(spark, sf_dir):
    found = q.exact_percentiles(read(spark, sf_dir, "lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.9, 0.99])
    return found.select("fraction", F.round("value", 4).alias("value"))


@query(
    "dq_topn_drift",
    with_fixtures(
        """
        SELECT key_value, left_n, right_n, left_share, right_share, right_share - left_share AS drift,
               (SELECT sum(abs(left_share - right_share)) / 2 FROM shares) AS distance
        FROM (SELECT *, row_number() OVER (ORDER BY left_n DESC, key_value) AS lr,
                     row_number() OVER (ORDER BY right_n DESC, key_value) AS rr FROM shares) s
        WHERE (lr <= 3 AND left_n > 0) OR (rr <= 3 AND right_n > 0)""",
        """shares AS (
            SELECT key_value, CAST(l AS BIGINT) AS left_n, CAST(r AS BIGINT) AS right_n,
                   CAST(l AS DOUBLE) / sum(l) OVER () AS left_share,
                   CAST(r AS DOUBLE) / sum(r) OVER () AS right_share
            FROM (SELECT o_orderstatus AS key_value, sum(l) AS l, sum(r) AS r
                  FROM (SELECT o_orderstatus, 1 AS l, 0 AS r FROM golden
                        UNION ALL SELECT o_orderstatus, 0, 1 FROM output) u GROUP BY o_orderstatus) c)""",
    ),
)
def dq_topn_drift(spark, sf_dir):
    return q.frequency_drift(
        fixture(spark, sf_dir, "golden"), fixture(spark, sf_dir, "output"), "o_orderstatus", 3
    )


RULES = (
    Rule("segment_known", "c_mktsegment", "null-check"),
    Rule("balance_range", "c_acctbal", "range", minimum=0, maximum=5000, severity="warning"),
    Rule("segment_format", "c_mktsegment", "format", pattern="^[A-M]", severity="info"),
    Rule("segment_is_number", "c_mktsegment", "type-check", type_name="int"),
    Rule("nation_small", "c_nationkey", "custom", expression="c_nationkey < 20 OR c_acctbal > 1000"),
    Rule("key_near_nation", "c_custkey", "range", target="c_nationkey", tolerance=500, severity="info"),
    Rule("same_key", "c_custkey", "exact-match", target="c_custkey"),
    Rule("off", "c_custkey", "null-check", enabled=False),
)

_RULE_SQL = (
    ("segment_known", "c_mktsegment", "null_violation", "c_mktsegment IS NULL", "critical", "NULL"),
    ("balance_range", "c_acctbal", "value_mismatch",
     "coalesce(c_acctbal < 0 OR c_acctbal > 5000, false)", "warning", "NULL"),
    ("segment_format", "c_mktsegment", "format_error",
     "coalesce(NOT regexp_matches(c_mktsegment, '^[A-M]'), false)", "info", "NULL"),
    ("segment_is_number", "c_mktsegment", "type_error",
     "c_mktsegment IS NOT NULL AND try_cast(c_mktsegment AS INT) IS NULL", "critical", "NULL"),
    ("nation_small", "c_nationkey", "value_mismatch",
     "NOT coalesce(c_nationkey < 20 OR c_acctbal > 1000, true)", "critical", "NULL"),
    ("key_near_nation", "c_custkey", "value_mismatch",
     "abs(c_custkey - c_nationkey) > 500", "info", "CAST(c_nationkey AS VARCHAR)"),
    ("same_key", "c_custkey", "value_mismatch", "false", "critical", "CAST(c_custkey AS VARCHAR)"),
)


@query(
    "dq_rule_flags",
    with_fixtures("SELECT c_custkey, " + ", ".join(f"{r[3]} AS {r[0]}" for r in _RULE_SQL) + " FROM customers"),
)
def dq_rule_flags(spark, sf_dir):
    return q.rule_flags(fixture(spark, sf_dir, "customers"), RULES, ["c_custkey"])


@query(
    "dq_rule_errors",
    with_fixtures(
        " UNION ALL ".join(
            f"SELECT CAST(c_custkey AS VARCHAR) AS row_key, '{field}' AS field_name, '{kind}' AS error_type,"
            f" CAST({field} AS VARCHAR) AS source_value, CAST({target} AS VARCHAR) AS target_value,"
            f" '{name}' AS rule, '{severity}' AS severity FROM customers WHERE {bad}"
            for name, field, kind, bad, severity, target in _RULE_SQL
        )
    ),
)
def dq_rule_errors(spark, sf_dir):
    return q.rule_errors(fixture(spark, sf_dir, "customers"), RULES, ["c_custkey"])


def _count_of(kind: str) -> str:
    return " + ".join(f"count(*) FILTER (WHERE {r[3]})" for r in _RULE_SQL if r[2] == kind)


@query(
    "dq_rule_counters",
    with_fixtures(
        "SELECT count(*) AS total_rows,"
        f" count(*) FILTER (WHERE NOT ({' OR '.join(f'({r[3]})' for r in _RULE_SQL)})) AS passed_rows,"
        f" count(*) FILTER (WHERE {' OR '.join(f'({r[3]})' for r in _RULE_SQL)}) AS failed_rows, "
        + ", ".join(
            f"{_count_of(k)} AS {k}" for k in ("value_mismatch", "format_error", "null_violation", "type_error")
        )
        + ", CAST(0 AS BIGINT) AS missing_row, CAST(0 AS BIGINT) AS extra_row FROM customers"
    ),
)
def dq_rule_counters(spark, sf_dir):
    return q.rule_counters(fixture(spark, sf_dir, "customers"), RULES)


_BUCKET = "CAST(('0x' || substr(md5('7|' || CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10000"


@query(
    "dq_sample_hash",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE {_BUCKET} < 500",
)
def dq_sample_hash(spark, sf_dir):
    return q.hash_sample(read(spark, sf_dir, "orders"), ["o_orderkey"], 500, seed=7).select("o_orderkey", "o_custkey")


@query(
    "dq_incremental",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01 00:00:00'",
)
def dq_incremental(spark, sf_dir):
    rows = q.select_rows(
        read(spark, sf_dir, "orders"), "incremental", water_column="o_orderdate", high_water=datetime(2000, 1, 1)
    )
    return rows.select("o_orderkey", "o_orderstatus")


@query(
    "dq_skew",
    "SELECT event_type AS key_value, count(*) AS n,"
    " CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) AS share,"
    " CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) > 0.2 AS skewed"
    " FROM events GROUP BY event_type ORDER BY n DESC, key_value LIMIT 3",
)
def dq_skew(spark, sf_dir):
    return q.key_skew(read(spark, sf_dir, "events"), "event_type", 3, 0.2)


@query(
    "dq_latest_flag",
    "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS latest_rows FROM orders"
    " GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') <> 1",
)
def dq_latest_flag(spark, sf_dir):
    return q.latest_flag_check(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "F")


_SCORED = """
    SELECT 'orders' AS dataset, 1 AS findings, 100 - 15 AS score
    UNION ALL SELECT 'events', CASE WHEN top > 0.2 * n THEN 1 ELSE 0 END, 100 - CASE WHEN top > 0.2 * n THEN 5 ELSE 0 END
    FROM (SELECT max(c) AS top, sum(c) AS n FROM (SELECT count(*) AS c FROM events GROUP BY event_type) g) e
    UNION ALL SELECT 'nothing', 1, 97
    UNION ALL SELECT 'absent', 1, 85
    UNION ALL SELECT 'nation', 1, 85"""


@query(
    "dq_confidence",
    f"SELECT dataset, CAST(findings AS BIGINT) AS findings, CAST(score AS BIGINT) AS score FROM ({_SCORED}) s",
)
def dq_confidence(spark, sf_dir):
    orders, events, nation = (read(spark, sf_dir, t) for t in ("orders", "events", "nation"))
    nothing = orders.where("o_orderkey < 0")
    findings = (
        q.profile_findings("orders", orders, "o_orderstatus", expected_count=1, skew_ratio=1.0)
        .union(q.profile_findings("events", events, "event_type", skew_ratio=0.2))
        .union(q.profile_findings("nothing", nothing))
        .union(
            q.schema_drift(
                {"absent": None, "nation": nation}, {"nation": ["n_nationkey", "n_name", "n_comment"]}, spark
            )
        )
    )
    return q.confidence_score(findings, ["orders", "events", "nothing", "absent", "nation"])


_CONFIGS = """
    SELECT concat('config_', CAST(c_custkey AS VARCHAR(20)), '.json') AS path,
           CASE WHEN c_custkey % 5 = 0 THEN '{broken'
                WHEN c_custkey % 5 = 1 THEN concat('{"job": {"name": "', c_name, '"}, "spark": {"catalog": {"type": "rest"}}}')
                WHEN c_custkey % 5 = 2 THEN concat('{"job": 1, "spark": {"s3": {"access_key": "a"}}, "data": {"input": {"path": "s3://b/', c_name, '"}}}')
                WHEN c_custkey % 5 = 3 THEN concat('{"job": 1, "spark": 1, "data": {"input": {"path": "/data/a b", "format": "csv"}, "output": {"catalog": "c", "database": "d", "table": "', c_mktsegment, '"}}}')
                ELSE concat('{"job": 1, "data": {"input": {"path": "ftp://', c_mktsegment, '", "format": "csv"}, "output": {"table": "t"}}}')
           END AS text
    FROM customer"""

# Findings that each of the five document kinds above must give.
_CONFIG_FINDINGS = """
    SELECT * FROM (VALUES
        (0, 'invalid_json', '', 'critical'),
        (1, 'missing_entry', 'data', 'critical'),
        (1, 'rest_catalog_without_uri', 'spark.catalog.uri', 'critical'),
        (2, 'missing_entry', 'data.input.format', 'warning'),
        (2, 'missing_entry', 'data.output', 'warning'),
        (2, 'missing_s3_setting', 'spark.s3.secret_key', 'critical'),
        (2, 'missing_s3_setting', 'spark.s3.endpoint', 'warning'),
        (2, 's3_scheme', 's3://b/', 'warning'),
        (3, 'path_with_space', '/data/a b', 'warning'),
        (4, 'missing_entry', 'spark', 'critical'),
        (4, 'missing_entry', 'data.output.catalog', 'warning'),
        (4, 'missing_entry', 'data.output.database', 'warning'),
        (4, 'unknown_scheme', 'ftp://', 'info')) AS v(kind, rule, entry, severity)"""


@query(
    "dq_config_documents",
    "SELECT concat('config_', CAST(c_custkey AS VARCHAR), '.json') AS config, v.rule,"
    " concat(v.entry, CASE v.rule WHEN 's3_scheme' THEN c_name WHEN 'unknown_scheme' THEN c_mktsegment ELSE '' END)"
    f" AS entry, v.severity FROM customer JOIN ({_CONFIG_FINDINGS}) v ON v.kind = c_custkey % 5",
)
def dq_config_documents(spark, sf_dir):
    return q.config_findings(run_sql(spark, sf_dir, _CONFIGS))



@query(
    "dq_schema_match",
    """
    SELECT 'p_partkey' AS column_name, 'ok' AS status, 'bigint' AS expected_type, 'bigint' AS actual_type,
           count(*) AS row_count, CAST(0 AS BIGINT) AS misfits FROM part
    UNION ALL SELECT 'p_name', 'type_mismatch', 'int', 'string', count(*), count(*) FILTER (WHERE try_cast(trim(p_name) AS INT) IS NULL) FROM part
    UNION ALL SELECT 'p_size', 'type_mismatch', 'string', 'int', count(*), 0 FROM part
    UNION ALL SELECT 'p_comment', 'missing', 'string', NULL, count(*), 0 FROM part
    UNION ALL SELECT unnest(['p_brand', 'p_type', 'p_retailprice']), 'extra', NULL, unnest(['string', 'string', 'double']), n, 0
    FROM (SELECT count(*) AS n FROM part) c""",
)
def dq_schema_match(spark, sf_dir):
    expected = {"p_partkey": "bigint", "p_name": "int", "p_size": "string", "p_comment": "string"}
    return q.schema_fit(read(spark, sf_dir, "part"), expected)


@query(
    "dq_key_fields",
    "SELECT l_orderkey, l_linenumber FROM lineitem",
)
def dq_key_fields(spark, sf_dir):
    return q.select_rows(read(spark, sf_dir, "lineitem"), "key-fields", ["l_orderkey", "l_linenumber"])


@query(
    "dq_rule_split",
    with_fixtures(
        f"""
        SELECT broken, count(*) AS n FROM (
            SELECT list_sort(list_filter([{', '.join(f"CASE WHEN {r[3]} THEN '{r[0]}' END" for r in _RULE_SQL)}], lambda x: x IS NOT NULL)) AS l,
                   CASE WHEN len(l) = 0 THEN 'none' ELSE array_to_string(l, ',') END AS broken FROM customers) x
        GROUP BY broken"""
    ),
)
def dq_rule_split(spark, sf_dir):
    good, bad = split_by_rules(fixture(spark, sf_dir, "customers"), RULES)
    named = bad.select(F.array_join(F.array_sort("broken_rules"), ",").alias("broken"))
    return named.union(good.select(F.lit("none"))).groupBy("broken").agg(F.count(F.lit(1)).alias("n"))
