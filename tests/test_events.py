"""The sliced walk gives what one pass over each key gives."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.operators import events as e
from tallymark.operators import windows

ORIGIN = dt.datetime(2024, 1, 1)


def plain_walk(times, interval, burst, free=e.NEVER):
    passed = []
    for t in times:
        ok, free = e.pass_count(t, 1, free, interval, burst)
        passed.append(bool(ok))
    return passed, free


def token_model(times, interval, burst):
    """Tokens as refilled and spent, in exact fractions of a token."""
    tokens, last, out = burst * interval, None, []
    for t in times:
        if last is not None:
            tokens = min(burst * interval, tokens + (t - last))
        last = t
        if tokens >= interval:
            tokens -= interval
            out.append(True)
        else:
            out.append(False)
    return out


TIMES = st.lists(st.integers(0, 300), min_size=1, max_size=60).map(sorted)


@settings(max_examples=300, deadline=None)
@given(TIMES, st.integers(1, 40), st.integers(1, 4))
def test_pass_rule_is_a_token_bucket(times, interval, burst):
    assert plain_walk(times, interval, burst)[0] == token_model(times, interval, burst)


@settings(max_examples=300, deadline=None)
@given(TIMES, st.integers(1, 40), st.integers(1, 4))
def test_slice_function_is_exact_for_every_start(times, interval, burst):
    t, n = np.unique(np.array(times, dtype="int64"), return_counts=True)
    bottom, top = int(t[0]), int(t[0]) + burst * interval
    found = e._pieces(lambda a, b: e._trace_slice(t, n, a, b, interval, burst), bottom, top)
    piece = (bottom, *[np.asarray(x, dtype="int64") for x in found])
    for free in range(bottom - 3, top + 1):
        assert e._apply(piece, free, 1 << 62)[0] == plain_walk(times, interval, burst, free)[1]


@settings(max_examples=200, deadline=None)
@given(TIMES, st.integers(1, 30), st.integers(1, 3), st.integers(5, 80))
def test_composed_functions_are_exact(times, interval, burst, width):
    functions = []
    for s in sorted({x // width for x in times}):
        t, n = np.unique(np.array([x for x in times if x // width == s], dtype="int64"), return_counts=True)
        bottom = int(t[0])
        found = e._pieces(lambda a, b, t=t, n=n: e._trace_slice(t, n, a, b, interval, burst), bottom, bottom + burst * interval)
        functions.append((bottom, *[np.asarray(x, dtype="int64") for x in found]))
    bottom = functions[0][0]
    found = e._pieces(lambda a, b: e._trace_chain(functions, a, b), bottom, bottom + burst * interval)
    whole = (bottom, *[np.asarray(x, dtype="int64") for x in found])
    for free in range(bottom - 2, bottom + burst * interval + 1):
        assert e._apply(whole, free, 1 << 62)[0] == plain_walk(times, interval, burst, free)[1]


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most events, several of them at the same time."""
    rng = random.Random(11)
    rows = [
        (i, ORIGIN + dt.timedelta(seconds=rng.randrange(0, 200_000)), "hot" if rng.random() < 0.8 else f"k{rng.randrange(20)}")
        for i in range(2500)
    ]
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp, k string")


def model(rows, interval, burst):
    out = set()
    for key in {r[2] for r in rows}:
        mine = sorted((r[1], r[0]) for r in rows if r[2] == key)
        times = [int((t - ORIGIN).total_seconds() * 1_000_000) for t, _ in mine]
        out |= {i for (_, i), ok in zip(mine, token_model(times, interval, burst)) if ok}
    return out


@pytest.mark.parametrize("interval,burst", [(60, 1), (90, 3), (7, 5)])
@pytest.mark.parametrize("tuning", [{}, {"slices": 7}, {"slices": 150}])
def test_walk_of_a_hot_key(hot, interval, burst, tuning):
    rows, df = hot
    out = e.token_bucket(df, F.col("k"), "ts", "event_id", interval * 1_000_000, burst, **tuning)
    got = {r.event_id: r for r in out.collect()}
    want = model(rows, interval * 1_000_000, burst)
    assert set(got) == {r[0] for r in rows}
    assert {i for i, r in got.items() if r.accepted} == want
    assert all((r.wait_seconds is None) == r.accepted and (r.accepted or r.wait_seconds > 0) for r in got.values())
    passing = e.passing_events(df, F.col("k"), "ts", "event_id", interval * 1_000_000, burst, **tuning)
    assert {r.event_id for r in passing.collect()} == want


def test_window_borders(spark):
    at = [0, 59, 60, 119, 120, 185]
    df = spark.createDataFrame([(i, ORIGIN + dt.timedelta(seconds=s), "a") for i, s in enumerate(at)], "event_id long, ts timestamp, k string")
    kept = e.dedup_window(df, F.col("k"), "ts", "event_id", 60)
    assert sorted(r.event_id for r in kept.collect()) == [0, 2, 4, 5]


def test_unlimited_priority_passes(spark):
    rows = [(i, ORIGIN, p) for i, p in enumerate([0] * 30 + [1] * 30 + [None] * 2)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, priority int")
    out = e.limit_by_priority(df, "priority", "ts", "event_id")
    accepted = {r.priority: r.n for r in out.where("accepted").groupBy("priority").agg(F.count("*").alias("n")).collect()}
    assert accepted == {0: 30, 1: 5, None: 2}
    assert out.count() == 62


def test_sessions_across_slices(spark):
    at = [0, 5, 10, 16, 3599, 3603, 7300]
    df = spark.createDataFrame([(i, ORIGIN + dt.timedelta(seconds=s), "a", f"p{i % 2}") for i, s in enumerate(at)], "event_id long, ts timestamp, k string, path string")
    for slices in (None, 2, 6):
        numbered = e.with_session(df, "k", "ts", "event_id", 5, slices)
        assert [r.session for r in numbered.orderBy("event_id").collect()] == [1, 1, 1, 2, 3, 3, 4]
    out = e.debounce(df, "k", "ts", "event_id", "path", 5).orderBy("first_event").collect()
    assert [(r.events, r.paths) for r in out] == [(3, 2), (1, 1), (2, 2), (1, 1)]


def test_missing_keys_are_one_key_and_missing_times_never_pass(spark):
    rows = [(1, ORIGIN, None), (2, ORIGIN + dt.timedelta(seconds=9), None), (3, ORIGIN, "a"), (4, None, "a")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, k string")
    assert sorted(r.event_id for r in e.dedup_window(df, F.col("k"), "ts", "event_id", 60).collect()) == [1, 3]
    out = {r.event_id: (r.accepted, r.wait_seconds) for r in e.token_bucket(df, F.col("k"), "ts", "event_id", 60_000_000, 1).collect()}
    assert out == {1: (True, None), 2: (False, 51.0), 3: (True, None), 4: (False, None)}


def test_one_key_at_one_second_is_spread_over_tasks(spark):
    df = spark.range(5000).select(F.col("id").alias("event_id"), F.lit(ORIGIN).alias("ts"), F.lit("a").alias("k"), F.lit(1).alias("n"))
    parts = windows.with_slices(df, ["k"], "ts", "event_id", 10).groupBy("__slice").count().collect()
    assert max(r["count"] for r in parts) < 1500
    assert windows.running_sum(df, ["k"], "ts", "event_id", "n", "upto", 10).where("upto <> event_id + 1").count() == 0


def test_the_function_of_an_overloaded_slice_has_few_pieces():
    """An overloaded bucket never fills, so that starts keep their phase; their decisions differ, their results hardly."""
    rng = random.Random(4)
    times = sorted(rng.sample(range(10**6), 20_000))
    t, n = np.array(times), np.array([rng.choice([1, 1, 3]) for _ in times])
    interval, burst = 400, 5
    found = e._slice_function(t, n, interval, burst)
    assert len(found[0]) <= 2 * burst + 3
    stored = (int(t[0]), *[np.array(x) for x in found])
    top = int(t[0]) + burst * interval
    for start in range(int(t[0]), top + 1, 171):
        assert e._apply(stored, start, top)[0] == e._trace_slice(t, n, start, top, interval, burst)[0]
    for _ in range(300):
        interval, burst = rng.randrange(1, 12), rng.randrange(1, 5)
        t = np.array(sorted(rng.sample(range(100, 160), rng.randrange(1, 14))))
        n = np.array([rng.choice([1, 1, 2, 5]) for _ in t])
        stored = (int(t[0]), *[np.array(x) for x in e._slice_function(t, n, interval, burst)])
        top = int(t[0]) + burst * interval
        for start in range(int(t[0]), top + 1):
            assert e._apply(stored, start, top)[0] == e._trace_slice(t, n, start, top, interval, burst)[0]
