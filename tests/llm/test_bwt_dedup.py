"""Removed bytes agree with a table of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tallymark.llm.bwt_dedup import anchors, remove_repeats, repeated_windows
from tallymark.llm.queries import op1_bwt_dedup

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    seen = Counter()
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_documents_agree_with_a_table_of_windows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute([(r["text"] or "").encode() for r in rows], 200)
    got = {r["doc_id"]: tuple(r)[1:] for r in op1_bwt_dedup(spark, SF).collect()}
    assert len(got) == len(rows) and sum(w[2] for w in want) > 20
    for r, (size, removed, spans, kept) in zip(rows, want, strict=True):
        assert got[r["doc_id"]] == (size, removed, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("bounds", [{}, {"group_segments": 2}, {"group_segments": 0, "merge_bytes": 2000}, {"merge_bytes": 500}])
def test_passages_edits_and_runs(spark, bounds):
    draw = np.random.default_rng(9)

    def noise(n):
        return "".join(chr(c) for c in draw.integers(97, 100, size=n))

    passages = [noise(int(n)) for n in (30, 39, 40, 41, 90, 300)]
    texts = ["", None, "short", "a" * 500, "ab" * 200, "é" * 90, noise(39)]
    for _ in range(60):
        t = noise(int(draw.integers(0, 80)))
        for _ in range(int(draw.integers(1, 4))):
            p = list(passages[int(draw.integers(len(passages)))])
            if draw.integers(2):
                p[int(draw.integers(len(p)))] = "Z"
            t += "".join(p) + noise(int(draw.integers(0, 60)))
        texts.append(t)
    texts += texts[-4:]
    ids = [None if i % 17 == 5 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, first int, kept string")
    got = [(r["id"], r["n_bytes"], sum(s["to"] - s["from"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in remove_repeats(df, length=40, **bounds).collect()]
    want = [(i, *w) for i, w in zip(ids, brute([(t or "").encode() for t in texts], 40), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_text_and_empty_table(spark):
    draw = np.random.default_rng(1)
    long = "".join(chr(c) for c in draw.integers(97, 123, size=2_500_000))
    df = spark.createDataFrame([(1, long), (2, "x" + long[1_200_000:1_300_000] + "y")], "doc_id long, text string")
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in remove_repeats(df).select("id", "spans").collect()}
    assert got == {1: [(1_200_000, 1_300_000)], 2: [(1, 100_001)]}
    assert remove_repeats(df.limit(0)).collect() == []


def test_refinement_agrees_with_comparing_windows():
    draw = np.random.default_rng(6)
    for _ in range(30):
        n = int(draw.integers(1, 25))
        group = draw.integers(0, 4, size=n)
        left = draw.integers(0, 9, size=n)
        windows = np.array([int(draw.integers(1, 9)) for _ in range(n)])
        texts = [bytes(draw.integers(97, 99, size=w + 5).tolist()) for w in windows]
        got = repeated_windows(group, left, windows, texts, 6)
        for i in range(n):
            for j in range(windows[i]):
                place = j - left[i]
                want = any(
                    k != i and group[k] == group[i] and 0 <= place + left[k] < windows[k]
                    and texts[k][place + left[k] : place + left[k] + 6] == texts[i][j : j + 6]
                    for k in range(n)
                )
                assert bool(got[i][j]) == want


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(8)
    data = bytes(draw.integers(97, 99, size=4000).tolist())
    anchor, _ = anchors(data + data[100:700], 50)
    assert np.array_equal(anchor[100:650] - 100, anchor[4000:4550] - 4000)
