"""Physical plans: shuffles, pushdown and the absence of cross joins."""

import re

import pytest
from pyspark.sql import functions as F

from tallymark.operators import compare as c
from tallymark.operators import events as e
from tallymark.operators import quality as q
from tallymark.operators import windows
from tallymark.plans import catalogue
from tallymark.plans.fixtures import fixture, read
from tallymark.specs import CompareSpec

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"\bExchange (?:hash|range|Single|RoundRobin)", plan(df)))


def test_key_diff_orders_whole_rows_of_differing_keys_only(spark):
    spec = CompareSpec(keys=("id",), tolerance="0.01")
    text = plan(c.diff_by_key(fixture(spark, SF, "golden"), fixture(spark, SF, "output"), spec))
    # Keys are counted on digests beforehand; rows are aggregated below a semi join with the keys that differ.
    assert text.count("SortAggregate") <= 2 and "LeftSemi" in text
    assert re.search(r"SortAggregate[^\n]*\n(?:.*\n){1,12}.*LeftSemi", text)


def test_multiset_is_one_shuffle_with_partial_counts(spark):
    df = c.diff_multiset(fixture(spark, SF, "lines_golden"), fixture(spark, SF, "lines_output"))
    assert shuffles(df) == 1 and plan(df).count("HashAggregate") == 2


def test_checks_read_only_their_columns(spark):
    df = q.run_checks(read(spark, SF, "lineitem"), [q.in_range("l_quantity", 1, 5), q.not_null("l_tax")])
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_tax:double>", plan(df))
    assert shuffles(df) == 1


def test_business_date_reaches_the_scan(spark):
    text = plan(catalogue.queries()["etl_business_date"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in text or "GreaterThanOrEqual(DT" in text


def test_dedup_limits_keys_before_the_shuffle(spark):
    text = plan(windows.first_per_key(read(spark, SF, "lineitem"), ["l_orderkey"], ["l_shipdate"]))
    assert re.search(r"WindowGroupLimit.*Partial", text) and "SortAggregate" not in text


def test_history_orders_whole_rows_of_touched_keys_only(spark):
    text = plan(catalogue.queries()["snapshot_history"](spark, SF))
    assert text.count("SortAggregate") <= 2 and re.search(r"SortAggregate[^\n]*\n(?:.*\n){1,12}.*LeftSemi", text)


@pytest.mark.parametrize("name", ["etl_dedup", "lookup_three", "etl_lookup_twice"])
def test_whole_rows_are_not_aggregated(spark, name):
    assert "SortAggregate" not in plan(catalogue.queries()[name](spark, SF))


def test_first_n_limits_groups_before_the_shuffle(spark):
    text = plan(windows.first_n_per_key(read(spark, SF, "lineitem"), ["l_orderkey"], [F.asc("l_shipdate")], 3))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_range_filter_joins_no_rows(spark):
    text = plan(catalogue.queries()["etl_range_join"](spark, SF))
    assert "Join" not in text and "scalar-subquery" in text or "Subquery" in text


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_cross_joins(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_walk_uses_no_unbounded_window(spark):
    df = e.dedup_window(read(spark, SF, "events"), F.col("user_id"), "ts", "event_id", 60)
    assert "Window" not in plan(df) and "MapInPandas" in plan(df)


def test_code_files_are_made_on_all_cores(spark):
    from tallymark.plans.corpus_queries import _code

    assert _code(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
