import random
from datetime import date

import numpy as np
import pytest

from tallymark.operators import quality as q
from tallymark.specs import Rule


def test_percentiles_match_numpy(spark):
    rng = random.Random(3)
    shapes = {
        "spread": [rng.random() * 1e6 for _ in range(3000)],
        "repeated": [float(rng.randrange(5)) for _ in range(3000)],
        "outlier": [rng.random() for _ in range(500)] + [1e300, -1e300],
        "single": [4.5],
        "two": [1.0, 2.0],
    }
    fractions = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for name, values in shapes.items():
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
        got = [r.value for r in q.exact_percentiles(df, "x", fractions, bins=16).collect()]
        assert got == pytest.approx(list(np.quantile(values, fractions)), rel=1e-12), name


def test_sketches_of_days_merge(spark):
    days = spark.range(60_000).selectExpr("id % 30 AS day", "CAST(id * 7919 % 60000 AS DOUBLE) AS x")
    sketches = q.quantile_sketches(days, "x", ["day"])
    month = q.sketch_percentiles(sketches, [0.0, 0.1, 0.5, 0.99]).collect()
    assert sketches.count() == 30 and {r.n for r in month} == {60_000}
    assert all(abs(r.value - r.fraction * 60_000) < 0.005 * 60_000 for r in month)
    assert {r.day for r in q.sketch_percentiles(sketches, [0.5], ["day"]).collect()} == set(range(30))


def test_percentiles_outside_their_brackets_are_found(spark, monkeypatch):
    exact = q._at_ranks
    monkeypatch.setattr(q, "_at_ranks", lambda v, b: exact(v, {r: ((1e9, 2e9) if e[0] > -1e300 else e) for r, e in b.items()}))
    df = spark.range(1001).selectExpr("CAST(id AS DOUBLE) AS x")
    assert [r.value for r in q.exact_percentiles(df, "x", [0.25, 0.5]).collect()] == [250.0, 500.0]


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert [r.value for r in q.exact_percentiles(df, "x", [0.5]).collect()] == [None]


def test_approximate_percentiles_are_close(spark):
    df = spark.range(10_000).selectExpr("CAST(id AS DOUBLE) AS x")
    assert abs(q.approximate_percentiles(df, "x", [0.5]).first().value - 5000) < 20


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert [(r.column_name, r.nulls, r.null_pct) for r in q.null_profile(df).collect()] == [("a", 0, None), ("b", 0, None)]
    assert [r.finding for r in q.profile_findings("t", df, "a", expected_count=3).collect()] == [
        "empty_dataset", "count_mismatch",
    ]


def test_skew_finding_and_score(spark):
    df = spark.createDataFrame([(1,)] * 8 + [(2,)] * 2, "k int")
    findings = q.profile_findings("t", df, "k", expected_count=10)
    assert [r.finding for r in findings.collect()] == ["key_skew"]
    assert [(r.findings, r.score) for r in q.confidence_score(findings, ["t"]).collect()] == [(1, 95)]


def test_score_never_negative(spark):
    rows = [("t", "schema_drift", "")] * 9
    findings = spark.createDataFrame(rows, "dataset string, finding string, detail string")
    assert q.confidence_score(findings, ["t", "u"]).orderBy("dataset").collect()[0].score == 0


def test_drift_names(spark):
    df = spark.createDataFrame([], "a int, b int")
    rows = q.schema_drift({"t": df, "u": None}, {"t": ["a", "c"]}, spark).collect()
    assert [(r.dataset, r.finding) for r in rows] == [("t", "schema_drift"), ("u", "table_missing")]
    assert q.schema_drift({}, {}, spark).first().finding == "no_tables"


def test_rules_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x1"), (3, "7")], "id int, v string")
    rules = [
        Rule("number", "v", "type-check", type_name="int"),
        Rule("filled", "v", "null-check"),
        Rule("shape", "v", "format", pattern="^[0-9]+$", allow_null=False),
        Rule("custom", "id", "custom", expression="id < 3 AND v IS NOT NULL", severity="info"),
    ]
    flags = {r.id: (r.number, r.filled, r.shape, r.custom) for r in q.rule_flags(df, rules, ["id"]).collect()}
    assert flags == {1: (False, True, True, True), 2: (True, False, True, False), 3: (False, False, False, True)}
    total = q.rule_counters(df, rules, missing_rows=2).first()
    assert (total.total_rows, total.passed_rows, total.failed_rows, total.missing_row) == (3, 0, 3, 2)
    with pytest.raises(ValueError):
        Rule("x", "v", "nonsense")


def test_sample_is_the_same_on_both_sides(spark):
    a = spark.range(2000).repartition(3)
    b = spark.range(1000, 3000).repartition(7)
    left = {r.id for r in q.hash_sample(a, ["id"], 1000).collect()}
    right = {r.id for r in q.hash_sample(b, ["id"], 1000).collect()}
    assert {i for i in left if i >= 1000} == {i for i in right if i < 2000}
    assert 100 < len(left) < 320
    assert {r.id for r in q.hash_sample(a, ["id"], 1000, seed=1).collect()} != left


def test_strategies(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 2, 1))], "id int, d date")
    assert q.select_rows(df, "full").count() == 2
    assert q.select_rows(df, "incremental", water_column="d", high_water=date(2024, 1, 15)).count() == 1
    assert q.select_rows(df, "key-fields", ["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        q.select_rows(df, "other")


def test_distinct_and_column_count(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b")], "x int, y string")
    assert [(r.column_name, r.distinct_values) for r in q.distinct_counts(df, ["x", "y"]).collect()] == [("x", 1), ("y", 2)]
    assert q.distinct_counts(df, ["y"], approximate=True).first().distinct_values == 2
    assert not q.column_count_check(df, 3).first().ok
    some = q.column_count_check(spark.createDataFrame([(1, None), (2, None)], "a int, b string"), 2).first()
    assert (some.ok, some.rows, some.empty_columns) == (True, 2, 1)
