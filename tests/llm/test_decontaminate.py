"""Leaks agree with the edit distance of every item to every text."""

import numpy as np
import pytest

from tallymark.llm.decontaminate import REPETITIONS, Items, Walks, _search, budget, find_leaks, least_edits, normal
from tallymark.llm.queries import op8_decontamination

SF = "/root/testdata/sf0.001"


def slow(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, q in items:
            q, x = normal(q), normal(t)
            if q and x and (e := least_edits(q, x)) <= budget(len(q)):
                out.add((d, i, e))
    return out


def test_documents_agree_with_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {tuple(r) for r in op8_decontamination(spark, SF).collect()}
    assert got == brute(docs, items) and got


def test_edit_distance():
    draw = np.random.default_rng(5)
    for _ in range(60):
        a, b = (bytes(draw.integers(97, 101, size=int(draw.integers(1, 30))).tolist()) for _ in range(2))
        assert least_edits(a, b) == slow(a, b)


def test_edited_passages_reach_the_recall(spark):
    draw = np.random.default_rng(11)
    words = ["".join(chr(c) for c in draw.integers(97, 123, size=int(draw.integers(2, 9)))) for _ in range(600)]

    def prose(n):
        return " ".join(words[int(i)] for i in draw.integers(0, len(words), size=n))

    items = [(i, prose(int(draw.integers(10, 50)))) for i in range(20)]
    docs = []
    for n in range(200):
        i, q = items[n % 20]
        q = list(q)
        for _ in range(int(draw.integers(0, budget(len(q)) + 3))):
            j, op = int(draw.integers(len(q))), int(draw.integers(3))
            q[j : j + (op != 1)] = [] if op == 2 else [chr(int(draw.integers(97, 123)))]
        docs.append((n, prose(20) + "\n " + "".join(q).title() + "  \t" + prose(30)))
    want = brute(docs, items)
    got = {tuple(r) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, i) for d, i, _ in got} <= {(d, i) for d, i, _ in want}
    assert len(got) >= 0.95 * len(want) and len(want) > 120


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "Say  CHEESE now", 1), (1, "Say  CHEESE now", 1), (2, None, 2), (None, "cheese", 3), (4, "", 4), (5, "x" * 300_000, 5)],
        "doc_id long, text string, edits long",
    )
    items = spark.createDataFrame([(7, "cheese"), (8, "CHEESE"), (9, ""), (10, None), (None, "x" * 100)], "item_id long, text string")
    got = sorted(map(str, (tuple(r) for r in find_leaks(docs, items).collect())))
    assert got == sorted(map(str, [(1, 7, 0), (1, 8, 0)] * 2 + [(None, 7, 0), (None, 8, 0), (5, None, 0)]))
    assert len(find_leaks(docs, items, slice_bytes=50).collect()) == 7
    assert find_leaks(docs.limit(0), items).collect() == [] and find_leaks(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("inserts_only", [False, True])
@pytest.mark.parametrize("size", [400, 1600, 6400])
def test_recall_does_not_fall_with_the_length_of_the_item(size, inserts_only):
    draw = np.random.default_rng(size)
    item = bytes(draw.integers(97, 123, size=size).tolist())
    held = Items([item])
    texts = []
    for _ in range(20):
        q = bytearray(item)
        for _ in range(budget(size)):
            j, op = int(draw.integers(len(q))), 0 if inserts_only else int(draw.integers(3))
            q[j : j + (op > 0)] = b"" if op == 2 else bytes([int(draw.integers(97, 123))])
        texts.append(bytes(draw.integers(97, 123, size=500).tolist()) + bytes(q) + bytes(draw.integers(97, 123, size=500).tolist()))
    assert budget(size) == size // 10
    got = _search(held, Walks(), texts)
    assert sum((d, 0) in got for d in range(20)) >= 19
    for (d, _), edits in got.items():
        assert edits == least_edits(item, texts[d])


def test_walks_do_not_grow_with_the_longest_item():
    item = bytes(np.random.default_rng(3).integers(97, 123, size=100_000).tolist())
    held = Items([item, b"a short item of some bytes"])
    assert held.keys.shape == (REPETITIONS, 501) and Walks().bits.nbytes < 10 << 20
    assert _search(held, Walks(), [b"before " + item + b" after"]) == {(0, 0): 0}
