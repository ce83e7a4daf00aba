"""Results that must not lose digits, rows or names."""

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymark.functions import scalars
from tallymark.operators import compare, corpus, hierarchy, history, quality
from tallymark.sources import readers
from tallymark.operators.shape import exact_sum
from tallymark.specs import CompareSpec


def test_small_sums_differ(spark):
    left, right = (spark.sql(f"SELECT CAST('{v}' AS DECIMAL(20,9)) AS v") for v in ("0.0000008", "0"))
    row = compare.reconcile_sums(left, right).first()
    assert not row.ok and float(row.delta) == 8e-7


def test_floating_sums_keep_nine_digits_and_stop_when_a_value_does_not_fit(spark):
    left, right = (spark.createDataFrame([(v,)], "v double") for v in (8e-7, 0.0))
    assert not compare.reconcile_sums(left, right).first().ok
    wide = spark.createDataFrame([(1e35,)], "v double")
    with pytest.raises(PySparkException):
        compare.reconcile_sums(wide, right).collect()


def test_whole_numbers_sum_beyond_a_long(spark):
    big = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "v long")
    assert int(compare.reconcile_sums(big, big).first().left_sum) == 2**64 - 2


def test_long_durations(spark):
    runs = spark.createDataFrame([(1, "completed", 2e12), (2, "completed", 4e12)], "request_id long, status string, duration_seconds double")
    assert runs.agg(history.exact_mean(F.col("duration_seconds")).alias("m")).first().m == 3e12


def test_long_words(spark):
    path = "/domain-" + "x" * 2000 + "/a.py"
    assert len(spark.range(1).select(scalars.domain_of(F.lit(path)).alias("d")).first().d) == 2000


def test_percentiles_of_wide_numbers(spark):
    values = [9007199254740993, 9007199254740995, 9007199254740997]
    out = quality.exact_percentiles(spark.createDataFrame([(v,) for v in values], "v long"), "v", [0.0, 0.5, 0.75, 1.0])
    assert [int(r.value) for r in out.orderBy("fraction").collect()] == [values[0], values[1], 9007199254740996, values[2]]
    small = spark.sql("SELECT CAST(x AS DECIMAL(38,20)) AS v FROM VALUES ('0.00000000000000000001'), ('0.00000000000000000003') t(x)")
    assert float(quality.exact_percentiles(small, "v", [0.5]).first().value) == 2e-20


def test_null_rates_are_per_row(spark):
    left = spark.createDataFrame([(1, "x")], "id int, v string")
    right = spark.createDataFrame([(1, None), (1, "x"), (1, "y"), (2, "z")], "id int, v string")
    report = compare.quality_report("t", left, right, CompareSpec(keys=("id",))).first()
    assert [r.null_rate for r in report.null_rate_summary] == [0.25]
    assert report.key_duplicate_count == 2


def test_digests_tell_nulls_by_their_place(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, "a", None)], "id int, v string, w string")
    right = spark.createDataFrame([(1, "a", None), (2, "a", None)], "id int, v string, w string")
    found = {r.id: r.status for r in compare.pair_by_key(left, right, CompareSpec(keys=("id",))).collect()}
    assert found == {1: "VALUE_MISMATCH", 2: "MATCH"}


def test_keys_without_values_are_in_the_history(spark):
    before = spark.createDataFrame([(1, None), (2, "a")], "id int, v string")
    after = spark.createDataFrame([(2, "b"), (3, None)], "id int, v string")
    rows = {tuple(r) for r in hierarchy.change_history(before, after, ["id"], ["v"]).collect()}
    assert rows == {(1, "removed", None, None, None), (2, "changed", "v", "a", "b"), (3, "added", None, None, None)}


def test_only_formatted_sql_is_a_finding(spark):
    text = "\n".join(['x = f"hello {y}"', 'z = spark.sql(f"SELECT {y}")', "w = spark.sql(f'''SELECT 1''')", 'spark.sql("SELECT 1")'])
    df = spark.createDataFrame([("p", text)], "path string, text string")
    assert {r.line for r in corpus.usage_findings(df).collect()} == {2, 3}


def test_statements_keep_their_lines(spark):
    text = 'a\nspark.sql("""\nSELECT 1\n""")\n\nspark.sql(\'SELECT 2\'); spark.sql("SELECT 2")\nspark.sql(f"x")\nspark . sql("n")'
    df = spark.createDataFrame([("p", text)], "path string, text string")
    assert [(r.line, r.statement) for r in corpus.sql_statements(df).collect()] == [(2, "SELECT 1"), (6, "SELECT 2"), (6, "SELECT 2")]


def test_table_names_to_try():
    assert readers.table_candidates("t", ["c"], "d") == ["t", "d.t", "c.d.t"]
    assert readers.table_candidates(" b.t ", ["c", "e"]) == ["b.t", "c.b.t", "e.b.t"]
    assert readers.table_candidates("a.b.t", ["c"]) == ["a.b.t"]


def test_layers_with_a_cycle_and_an_unknown_dependency(spark):
    jobs = spark.createDataFrame([(x,) for x in "abcdefg"], "job_id string")
    edges = spark.createDataFrame(
        [("b", "a"), ("c", "a"), ("c", "b"), ("d", "e"), ("e", "d"), ("f", "nowhere"), ("c", "a"), ("g", None)], "job_id string, depends_on string"
    )
    got = {r.job_id: r.layer for r in hierarchy.execution_layers(jobs, edges).collect()}
    assert got == {"a": 0, "g": 0, "b": 1, "c": 2, "d": 3, "e": 3, "f": 3}


def test_sums_keep_small_beside_large_values(spark):
    rows = [(1e15,)] * 3 + [(4e-12,)] * 1000 + [(-1e15,)] * 3 + [(None,)]
    df = spark.createDataFrame(rows, "v double").repartition(7)
    assert df.agg(exact_sum(F.col("v")).alias("s")).first()["s"] == pytest.approx(4e-9, rel=1e-12)
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([(1e30,)], "v double").agg(exact_sum(F.col("v"))).collect()


def test_decimal_sums_stop_where_a_digit_would_be_lost(spark):
    df = spark.createDataFrame([(4e-10,), (1.5,)], "v double")
    with pytest.raises(Exception, match="9 digits"):
        compare.reconcile_sums(df, df).collect()
    assert compare.reconcile_sums(df, df, scale=12).first()["left_sum"] == Decimal("1.500000000400")
