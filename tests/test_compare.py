"""Comparison semantics on hand-made frames and against a dictionary model."""

import math
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.operators import compare as c
from tallymark.specs import CompareSpec


def frame(spark, rows, schema="k int, a string, x double"):
    return spark.createDataFrame(rows, schema)


def diffs(spark, left, right, schema="k int, a string, x double", **spec):
    out = c.diff_by_key(frame(spark, left, schema), frame(spark, right, schema), CompareSpec(keys=("k",), **spec))
    return sorted((r.k if r.k is not None else -1, r.mismatch_type) for r in out.collect())


def test_null_keys_match_each_other(spark):
    assert diffs(spark, [(None, "a", 1.0)], [(None, "a", 1.0)]) == []
    assert diffs(spark, [(None, "a", 1.0)], [(1, "a", 1.0)]) == [(-1, c.MISSING), (1, c.EXTRA)]


def test_null_against_value_is_a_mismatch(spark):
    assert diffs(spark, [(1, None, 1.0)], [(1, "<NULL>", 1.0)]) == [(1, c.CHANGED)]
    assert diffs(spark, [(1, None, None)], [(1, None, None)]) == []


def test_tolerance_is_inclusive_and_not_rounding(spark):
    assert diffs(spark, [(1, "a", 0.0149)], [(1, "a", 0.0151)], tolerance="0.01") == []
    schema = "k int, x decimal(10,2)"
    assert diffs(spark, [(1, Decimal("1.00"))], [(1, Decimal("1.01"))], schema, tolerance="0.01") == []
    assert diffs(spark, [(1, Decimal("1.00"))], [(1, Decimal("1.02"))], schema, tolerance="0.01") == [(1, c.CHANGED)]


def test_nan_equals_nan_only(spark):
    nan = math.nan
    assert diffs(spark, [(1, "a", nan)], [(1, "a", nan)], tolerance="0.1") == []
    assert diffs(spark, [(1, "a", nan)], [(1, "a", 1.0)], tolerance="0.1") == [(1, c.CHANGED)]


def test_duplicate_keys_are_reported_and_compare_deterministically(spark):
    left = [(1, "b", 1.0), (1, "a", 1.0)]
    assert diffs(spark, left, [(1, "a", 1.0)]) == [(1, c.DUPLICATE_GOLDEN)]
    assert diffs(spark, left, [(1, "b", 1.0), (1, "b", 1.0)]) == [
        (1, c.DUPLICATE_GOLDEN), (1, c.DUPLICATE_OUTPUT), (1, c.CHANGED),
    ]


def test_only_key_columns(spark):
    assert diffs(spark, [(1,), (2,)], [(2,), (3,)], "k int") == [(1, c.MISSING), (3, c.EXTRA)]


def test_missing_key_column_fails_before_any_job(spark):
    left = frame(spark, [], "k int, a string")
    right = frame(spark, [], "a string")
    with pytest.raises(ValueError, match="output"):
        c.diff_by_key(left, right, CompareSpec(keys=("k",)))
    with pytest.raises(ValueError, match="golden"):
        c.rows_without_partner(right, left, ["k"])


def test_text_golden_is_cast_to_the_output_types(spark):
    golden = frame(spark, [("1", "2.50"), ("2", "x"), ("3", "4")], "k string, x string")
    output = frame(spark, [(1, Decimal("2.50")), (2, Decimal("1")), (3, Decimal("4"))], "k int, x decimal(8,2)")
    out = c.diff_by_key(golden, output, CompareSpec(keys=("k",)))
    assert [(r.k, r.mismatch_type) for r in out.collect()] == [(2, c.TYPE_ERROR)]


def test_separators_do_not_collide(spark):
    left = frame(spark, [("a", "b||c")], "a string, b string")
    right = frame(spark, [("a||b", "c")], "a string, b string")
    assert c.diff_multiset(left, right).count() == 2


def test_multiset_counts(spark):
    left = frame(spark, [(1,), (1,), (2,), (None,)], "a int")
    right = frame(spark, [(1,), (2,), (2,), (None,)], "a int")
    got = {r.a: (r.golden_count, r.output_count) for r in c.diff_multiset(left, right).collect()}
    assert got == {1: (2, 1), 2: (1, 2)}


def test_sums_with_null_side_fail(spark):
    left = frame(spark, [(1, "a", 1.0)])
    right = frame(spark, [(1, "a", None)])
    got = {r.column_name: r.ok for r in c.reconcile_sums(left, right, tolerance=5).collect()}
    assert got == {"k": True, "x": False}


def test_summary_verdict_and_empty_tables(spark):
    empty, one = frame(spark, []), frame(spark, [(1, "a", 1.0)])
    spec = CompareSpec(keys=("k",))
    assert c.compare_summary(empty, empty, spec).first().passed
    assert not c.compare_summary(empty, one, spec).first().passed
    wide = one.withColumn("extra", F.lit(1))
    row = c.compare_summary(one, wide, spec).first()
    assert not row.passed and row.schema.only_in_right == ["extra"]
    assert c.compare_summary(one, wide, CompareSpec(keys=("k",), ignore=("extra",))).first().passed
    assert not c.compare_summary(one, one.union(one), CompareSpec()).first().passed


def test_schema_diff_and_audit_columns(spark):
    left = frame(spark, [], "k int, a string, load_ts timestamp")
    right = frame(spark, [], "k long, b string, load_ts timestamp")
    got = {(r.column_name, r.difference) for r in c.schema_diff(left, right, ["load_ts"]).collect()}
    assert got == {("k", "type_mismatch"), ("a", "only_in_left"), ("b", "only_in_right")}
    blank = c.audit_normalised(left, blank=["load_ts"])
    assert blank.schema == left.schema


ROWS = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.sampled_from("ab")), st.integers(0, 2)),
    max_size=8,
)
QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _order(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@QUICK
@given(ROWS, ROWS)
def test_key_diff_matches_model(spark, left, right):
    schema = "k int, a string, x int"
    want = Counter()
    for k in {r[0] for r in left + right}:
        ls = sorted((r[1:] for r in left if r[0] == k), key=_order)
        rs = sorted((r[1:] for r in right if r[0] == k), key=_order)
        if not rs:
            want[k, c.MISSING] += 1
        elif not ls:
            want[k, c.EXTRA] += 1
        elif ls[0] != rs[0]:
            want[k, c.CHANGED] += 1
        if len(ls) > 1:
            want[k, c.DUPLICATE_GOLDEN] += 1
        if len(rs) > 1:
            want[k, c.DUPLICATE_OUTPUT] += 1
    out = c.diff_by_key(frame(spark, left, schema), frame(spark, right, schema), CompareSpec(keys=("k",)))
    assert Counter((r.k, r.mismatch_type) for r in out.collect()) == want


@QUICK
@given(ROWS, ROWS)
def test_multiset_matches_model(spark, left, right):
    schema = "k int, a string, x int"
    a, b = Counter(left), Counter(right)
    want = {r: (a[r], b[r]) for r in set(a) | set(b) if a[r] != b[r]}
    out = c.diff_multiset(frame(spark, left, schema), frame(spark, right, schema))
    assert {(r.k, r.a, r.x): (r.golden_count, r.output_count) for r in out.collect()} == want
