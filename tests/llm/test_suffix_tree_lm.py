"""Counts, base scores and tree scores agree with plain dictionaries."""

import math
import os
import re
import tempfile
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import suffix_tree_lm as lm
from tallymark.llm.queries import op6_suffix_tree_scores
from tallymark.session import stored

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def brute(train, texts, least=lm.LEAST_COUNT):
    """Scores by a suffix tree kept in dictionaries."""
    one, after = Counter(), {}
    for t in train:
        w = words(t)
        one.update(w)
        for i in range(len(w)):
            for d in range(1, lm.DEPTH + 1):
                if i >= d:
                    after.setdefault(tuple(w[i - d : i]), Counter())[w[i]] += 1
    n, v = sum(one.values()), len(one)
    kept = set()
    for s, c in after.items():
        size = sum(c.values())
        if size < least:
            continue
        below = after[s[1:]] if s[1:] else one
        gap = sum(m / size * math.log(m / size / (below[w] / sum(below.values()))) for w, m in c.items()) - (len(c) - 1) / (2 * size)
        if gap >= lm.DIVERGENCE:
            kept.add(s)

    def p(w, s):
        while s and s not in kept:
            s = s[1:]
        if not s:
            return (one[w] + 1) / (n + v + 1)
        c = after[s]
        return (c[w] + len(c) * p(w, s[1:])) / (sum(c.values()) + len(c))

    out = []
    for t in texts:
        w = words(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        tree = sum(math.log10(p(x, tuple(w[max(0, i - lm.DEPTH) : i]))) for i, x in enumerate(w))
        out.append((len(w), sum(one[x] > 0 for x in w), base, tree))
    return n, out, kept


def test_documents_agree_with_dictionaries(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    n, want, kept = brute([r["text"] for r in rows if not held[r["doc_id"]]], [r["text"] for r in rows])
    got = {r["doc_id"]: r for r in op6_suffix_tree_scores(spark, SF).collect()}
    assert len(got) == len(rows) and {len(s) for s in kept} == set(range(1, lm.DEPTH + 1))
    for r, (tokens, known, base, tree) in zip(rows, want, strict=True):
        g = got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[r["doc_id"]], tokens, known, n)
        assert g["base_score"] == pytest.approx(base, abs=1e-6) and g["score"] == pytest.approx(tree, abs=1e-6)


@pytest.mark.parametrize("block_bytes", [60_000, 1 << 20])
def test_contexts_help_held_out_text_and_blocks_do_not_matter(spark, block_bytes):
    draw = np.random.default_rng(4)
    follow = {i: draw.integers(0, 30, size=3) for i in range(30)}

    def text(n):
        w = [int(draw.integers(30))]
        for _ in range(n):
            w.append(int(follow[w[-1]][draw.integers(3)]))
        return " ".join(f"W{x}" for x in w)

    train = [text(40) for _ in range(120)]
    rest = [text(40) for _ in range(20)] + ["", None, "x y z", "w1  W2\tw3\n", "x" * 3_000_000]
    texts = [(i, t, None if i % 2 else False, 1.0) for i, t in enumerate(rest)] + [(-1, t, True, 1.0) for t in train]
    docs = spark.createDataFrame(texts, "doc_id long, text string, learn boolean, score double")
    found = lm.score_corpus(docs, F.col("learn"), least_count=25, block_bytes=block_bytes)
    got = {r["id"]: r for r in found.rows.collect()}
    _, want, kept = brute(train, rest, 25)
    assert kept and found.states == len(kept) and found.rows.count() == len(texts)
    for i, (tokens, known, base, tree) in enumerate(want):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (tokens, known)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-6) and got[i]["score"] == pytest.approx(tree, abs=1e-6)
    assert sum(got[i]["score"] for i in range(20)) > sum(got[i]["base_score"] for i in range(20)) + 100


def test_files_of_finished_exchanges_are_gone(spark):
    def files():
        folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
        return set(Path(folder).rglob("shuffle_*.data"))

    draw = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in draw.integers(500, size=400))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = files()
    lm.score_corpus(docs, F.lit(True), block_bytes=60_000)
    # What little is left belongs to the totals, which have one row per part.
    assert sum(f.stat().st_size for f in files() - before) < 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found = lm.score_corpus(none, F.lit(True))
    assert (found.tokens, found.kinds, found.states) == (0, 0, 0) and found.rows.collect() == []
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in lm.score_corpus(one, F.lit(None).cast("boolean")).rows.collect()] == [(None, 3, 0, 0.0, 0.0)]


def test_a_context_stays_a_state_in_a_larger_corpus(spark):
    """The same context with the same counts, beside ever more other text."""
    train = ["alpha beta gamma"] * 45 + ["delta beta epsilon"] * 45
    other = [" ".join(f"w{(i * 7919 + j * j) % 50_000}" for j in range(1000)) for i in range(200)]
    gained = {}
    for name, extra in (("small", other[:20]), ("large", other)):
        rows = [(1, t) for t in train + extra] + [(0, "alpha beta gamma")]
        found = lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 1)
        row = found.rows.where("id = 0").first()
        gained[name] = row["score"] - row["base_score"]
        assert found.states >= 2
    assert gained["large"] > gained["small"] > 5


def test_blocks_are_not_moved(spark):
    docs = spark.createDataFrame([(i, "a b c d " * 60) for i in range(40)], "doc_id long, text string")
    rows = lm.score_corpus(docs, F.lit(True), block_bytes=2000).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_exchanges_send_small_keys(spark, monkeypatch):
    def files():
        folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
        return {f: f.stat().st_size for f in Path(folder).rglob("shuffle_*.data")}

    before, sent = files(), {}

    def kept(df):
        # The files of the exchange stay until they have been seen.
        out = stored(df)
        sent.update({f: size for f, size in files().items() if f not in before})
        return out

    draw = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in np.minimum(draw.zipf(1.3, size=2000), 5000))) for i in range(150)]
    monkeypatch.setattr(lm, "passed_on", kept)
    lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), block_bytes=400_000)
    assert 0 < sum(sent.values()) < 2_000_000


@pytest.mark.parametrize(("size", "parts"), [(1, 1), (1000, 7), (1 << 16, 3), (60_001, 64)])
def test_scattered_keys_are_distinct_and_lie_in_their_parts(size, parts):
    share = lm._share(size, parts)
    keys = lm._keys(np.arange(size, dtype=np.uint64), size, parts, 5, share + 9)
    assert len(np.unique(keys)) == size
    part, rest = np.divmod(keys, np.uint64(share + 9))
    assert part.max() < parts and rest.min() >= 5 and rest.max() < share + 5
    if size > 50 * parts:
        assert np.bincount(part.astype(int), minlength=parts).max() < 1.5 * size / parts
