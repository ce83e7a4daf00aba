"""Groups agree with comparing all pairs."""

import re

import numpy as np
import pytest

from tallymark.llm import components, minhash
from tallymark.llm.components import connected_components, merged
from tallymark.llm.minhash import near_groups
from tallymark.llm.queries import op4_minhash
from tallymark.llm.words import hash_many, hash_words
from tallymark.session import stored

SF = "/root/testdata/sf0.001"


def brute(rows, k):
    sets = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        n = min(k, len(words))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if words else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            s, t = sets[i], sets[j]
            if 100 * min(len(s), len(t)) < 80 * max(len(s), len(t)):
                continue
            both = len(s & t)
            if 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def got(df, name="id"):
    return {r[name]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_documents_agree_with_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op4_minhash(spark, SF), "doc_id") == brute(rows, 2)


@pytest.mark.parametrize("k", [2, 5])
def test_edited_copies(spark, k):
    draw = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = [f"w{draw.integers(400)}" for _ in range(int(draw.integers(5, 120)))]
        for _ in range(8):
            words = list(base)
            for _ in range(int(draw.integers(0, max(2, len(base) // 12)))):
                words[int(draw.integers(len(words)))] = f"x{draw.integers(99)}"
            rows.append((len(rows) * 3 + 1, (" \t" if g % 2 else "\n").join(words)))
    rows += [(900, ""), (901, None), (902, "One"), (903, "one"), (904, " \n"), (905, "a b"), (906, "É b"), (907, "é b")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, component_id int, n string")
    assert got(near_groups(df, k)) == brute(rows, k)


def test_one_identifier_with_two_texts_loses_no_link(spark):
    w, u = " ".join(f"w{i}" for i in range(200)), " ".join(f"u{i}" for i in range(200))
    rows = [(1, w), (1, u), (2, w + " more"), (3, u + " more"), (4, "x y z")]
    out = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["id"], r["component_id"], r["kept"]) for r in out) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


@pytest.mark.parametrize("paired,block", [(0, 16), (3, 512), (10**6, 1)])
def test_open_members_of_large_buckets(spark, monkeypatch, paired, block):
    """A family of copies near the limit of similarity: many do not reach the head, some reach each other, some nobody."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "_BLOCK_ROWS", block)
    draw = np.random.default_rng(11)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(160):
        words = list(base)
        for _ in range(int(draw.integers(2, 16))):
            words[int(draw.integers(len(words)))] = f"x{draw.integers(10**6)}"
        rows.append((i, " ".join(words)))
    want = brute(rows, 2)
    assert 5 < len({c for _, c, _ in want.values()}) < 150
    assert got(near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == want


def test_thousands_below_the_similarity_stay_linear(spark, monkeypatch):
    """One bucket of unlinked members makes no rows per pair."""
    made = []
    monkeypatch.setattr(minhash, "stored", lambda df: made.append(stored(df)) or made[-1])
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(2500):
        words = list(base)
        for j in range(14):
            words[(i * 7 + j * 13) % 200] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    out = near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 2)
    assert out.where("kept").count() > 2400
    assert max(df.count() for df in made) < 70 * len(rows)


def test_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 9973}v{i % 7919}" for i in range(150_000))
    rows = [(2, long), (1, long + " end"), (3, "w " * 100_000), (4, "short text of five words"), (5, "")]
    names = ["row", "id", "version", "node", "n", "set_a", "bands", "sketch", "key", "component", "kept", "size", "group"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ", ".join(["doc_id long, text string", *[f"{n} int" for n in names]]))
    assert {i: v[1:] for i, v in got(near_groups(df, 5)).items()} == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True)}


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    out = sorted(tuple(r)[:4] for r in near_groups(df, 2).where("id is not null").collect())
    assert out == [(1, 5, 1, True)] * 2
    assert near_groups(df.limit(0), 2).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)}


def test_components_merged_with_further_links(spark):
    draw = np.random.default_rng(5)
    links = [tuple(int(x) for x in draw.integers(400, size=2)) for _ in range(330)]
    first, more = (spark.createDataFrame(rows, "a long, b long") for rows in (links[:230], links[230:]))
    want = dict(connected_components(first.union(more)).collect())
    assert dict(merged(connected_components(first), more).collect()) == want
    assert dict(merged(connected_components(first.limit(0)), more).collect()) == dict(connected_components(more).collect())


def test_rounds_on_many_partitions_are_few_and_in_few_files(spark, monkeypatch):
    """With hundreds of shuffle partitions a narrow step is written in at most four files per core, and few steps run."""
    made = []

    def kept(df):
        made.append(stored(df))
        return made[-1]

    monkeypatch.setattr(minhash, "stored", kept)
    monkeypatch.setattr(components, "stored", kept)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(120):
        words = [f"{w}f{i % 6}" for w in base]
        for j in range(i % 5):
            words[(i * 7 + j * 13) % 120] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    hot = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in hot}
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        assert got(near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute(rows, 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    narrow = [len(df.inputFiles()) for df in made if set(df.columns) <= {"a", "b", "u", "v", "m", "node", "times", "component"}]
    assert len(narrow) >= 8 and max(narrow) <= 4 * spark.sparkContext.defaultParallelism
    assert len(made) <= 45


def test_word_hashes_are_the_same_in_any_batch():
    texts = [b"a b", b"", b"\x00\x00 x", b" tab\tnew\nline ", b"z" * 300 + b" y"]
    words, begin = hash_many(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(words[begin[i] : begin[i + 1]], hash_words(t))
