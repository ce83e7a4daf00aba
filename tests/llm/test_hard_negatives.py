"""Mined negatives agree with scoring every pair; the intervals hold every score."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import hard_negatives
from tallymark.llm import queries as q
from tallymark.llm.hard_negatives import Planes, encode, exact, mine
from tests import oracle

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, score long, size int, uid string, asks int"


@pytest.mark.parametrize("size,layers,planes", [(1, 1, 4), (7, 2, 8), (64, 1, 8), (64, 4, 6), (130, 3, 8)])
def test_intervals_hold_the_scores(size, layers, planes):
    rng = np.random.default_rng(size)
    vectors = np.concatenate([rng.integers(-300, 300, (200, size)), np.zeros((1, size), dtype=np.int64), rng.integers(-2, 3, (50, size))])
    queries = vectors[::9]
    lower, upper = Planes(queries, layers, planes).interval(slice(None), *encode(vectors, layers))
    true = queries @ vectors.T
    assert (lower <= true).all() and (true <= upper).all()


def test_layers_narrow_the_intervals():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(4000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    width = []
    for layers in (1, 2, 4):
        lower, upper = Planes(vectors[:20], layers).interval(slice(None), *encode(vectors, layers))
        width.append((upper - lower).mean())
    assert width[0] > 1.4 * width[1] > 2 * width[2]
    best = np.sort(vectors[:20] @ vectors.T, axis=1)[:, -6]
    assert (upper >= best[:, None]).mean() < 0.2


def test_exact_scores_beyond_doubles():
    big = np.array([[1 << 40, 3], [1 << 31, -(1 << 31)]], dtype=np.int64)
    assert exact(big, np.array([1 << 20, 1], dtype=np.int64)).tolist() == [(1 << 60) + 3, (1 << 51) - (1 << 31)]


def test_query_agrees_with_its_sql(spark):
    name = "op12_hard_negatives"
    df = q.QUERIES[name](spark, SF)
    cur = oracle.duck(SF).execute(q.ORACLES[name])
    names = [d[0] for d in cur.description]
    got = Counter(map(tuple, df.select(*names).collect()))
    assert got and got == Counter(cur.fetchall())


def brute(rows, low=80, high=100, count=3):
    usable = [(n, i, [math.floor(8 * x) for x in v], c) for n, (i, v, c) in enumerate(rows) if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = Counter()
    for n, i, v, c in usable:
        if i is None or i % 10:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m, k == c) for m, j, w, k in usable if m != n and len(w) == len(v)]
        for score, j, _, _ in sorted((s for s in scored if s[3]), key=order)[:count]:
            fits = [s for s in scored if not s[3] and low * score <= 100 * s[0] <= high * score]
            for rank, found in enumerate(sorted(fits, key=order)[:count], 1):
                out[i, j, rank, found[1], score, found[0]] += 1
    return out


@pytest.mark.parametrize("parts,row_block,anchor_block", [(1, 8192, 1024), (5, 16, 3)])
def test_odd_rows_and_ties(spark, parts, row_block, anchor_block):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [1.0, float("nan"), 0.0, 0.0], 1), (203, [1.0, float("inf"), 0.0, 0.0], 1), (204, [1.0] * 4, None)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 0), (210, [0.0] * 4, 1), (220, [2.0, 1.0], 1), (221, [2.0, 1.5], 1), (222, [2.0, 1.0], 0), (230, [], 1), (231, [], 1), (232, [], 2), (-10, [-0.06, 0.49, 1.0, 2.0], 2)]
    df = spark.createDataFrame([(*r, 1, 2, "u", 3) for r in rows], SCHEMA).repartition(4)
    found = mine(df, F.col("vec_id") % 10 == 0, positives=3, negatives=3, scale=8, parts=parts, row_block=row_block, anchor_block=anchor_block)
    got = Counter(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == brute(rows)


def test_repeated_rows_are_rows(spark):
    rows = [(10, [1.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [0.0, 1.0], 0)]
    found = mine(spark.createDataFrame([(*r, 1, 2, "u", 3) for r in rows], SCHEMA), F.col("vec_id") % 10 == 0, positives=3, negatives=3, scale=8)
    got = Counter(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == brute(rows)


def test_empty_table(spark):
    assert mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []


def test_driver_gathers_no_blocks(spark, monkeypatch):
    """The copies of the anchors would all lie in the driver if they were broadcast."""
    plans = []
    kept = hard_negatives.stored
    monkeypatch.setattr(hard_negatives, "stored", lambda df: plans.append(df) or kept(df))
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], int(rng.integers(0, 3)), 1, 2, "u", 3) for i in range(300)]
    plans.append(mine(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 10 == 0, row_block=32, anchor_block=8))
    said = [df._jdf.queryExecution().toString() for df in plans]
    assert sum("SortMergeJoin" in x for x in said) >= 3
    assert not [x for x in said if "Broadcast" in x]


@pytest.mark.parametrize("held", [1, 2])
def test_groups_of_anchors(spark, monkeypatch, held):
    monkeypatch.setattr(hard_negatives, "HELD", held)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4 + i % 2)], int(rng.integers(0, 3))) for i in range(120)]
    df = spark.createDataFrame([(*r, 1, 2, "u", 3) for r in rows], SCHEMA).repartition(3)
    found = mine(df, F.col("vec_id") % 10 == 0, positives=3, negatives=3, scale=8, parts=4, row_block=16, anchor_block=3)
    got = Counter(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got and got == brute(rows)


def test_blocks_meet_once_in_places_of_their_own(spark):
    numbers = [(task << 24) + n for task in range(3) for n in range(5)]
    left = spark.createDataFrame([(2 + n % 2, n) for n in numbers], "size int, block long")
    right = spark.createDataFrame([(2 + n % 2, n // 2, n) for n in range(9)], "a_size int, a_part int, anchors int")
    met = hard_negatives._meet(left, right, 4, 2).withColumn("place", F.spark_partition_id()).collect()
    assert Counter((r.block, r.anchors) for r in met) == Counter((n, a) for n in numbers for a in range(9) if n % 2 == a % 2)
    assert {len({r.place for r in met if r.block == n}) for n in numbers} == {2}
    assert len({r.place for r in met}) == 8
