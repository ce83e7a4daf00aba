"""The operators made of column functions: exact copies, shards, repeated lines."""

import hashlib
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymark.llm import queries as q
from tallymark.llm.content_sort import exact_distinct, exact_groups
from tallymark.llm.histogram_shard import byte_splitters, shard_by_bytes
from tallymark.llm.line_windows import drop_repeated_lines, repeated_lines
from tests import oracle

SF = "/root/testdata/sf0.001"
ODD = "id long, text string, head string, salt int, kept int, size int, shard int, row string"
TEXTS = [None, "", "A\nb", "a\nB", "É", "é", "x" * 200_000, "X" * 200_000, "same", "same", " ", "a\nb\nc\nd", "0\na\nb\nc", "a\nb\nc\na\nb\nc", "\n\n\n\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "h", 1, 2, 3, 4, "r") for i, t in enumerate(TEXTS)] + [(3, "a\nB", "h", 1, 2, 3, 4, "r"), (None, "same", "h", 1, 2, 3, 4, "r"), (None, "alone", "h", 1, 2, 3, 4, "r")]
    return rows, spark.createDataFrame(rows, ODD)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op9_line_dedup"])
def test_queries_agree_with_their_sql(spark, name):
    df = q.QUERIES[name](spark, SF)
    cur = oracle.duck(SF).execute(q.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(cur.fetchall())


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("salts", [1, 32])
def test_exact_copies(odd, keep, salts):
    rows, df = odd
    groups: dict[str, list] = {}
    for i, t, *_ in rows:
        groups.setdefault(fold(t), []).append(i)
    pick = min if keep == "smallest" else max
    got = exact_groups(df, "id", "text", keep, salts).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(fold(t) for i, t, *_ in rows if i == r["id"] and hashlib.sha256(fold(t).encode()).hexdigest() == r["sha256"])
        known = [i for i in groups[text] if i is not None]
        assert (r["keep_id"], r["group_size"]) == (pick(known) if known else None, len(groups[text]))
    assert Counter(r["sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    left = exact_distinct(df, "id", "text", keep, salts)
    assert left.columns == df.columns and Counter(fold(r["text"]) for r in left.collect()) == Counter(list(groups))


def test_a_third_of_all_rows_are_copies(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "Copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_groups(df, "id", "text", "largest")
    assert out.where("kept").count() == 2001
    assert out.where("keep_id = 2997 AND group_size = 1000").count() == 1000


def test_shards_have_equal_bytes_and_gapless_slots(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = q.op3_histogram_shards(spark, SF).collect()
    assert len(got) == len(docs)
    total = sum(len(t.encode()) + 1 for t in docs.values())
    longest = max(len(t.encode()) + 1 for t in docs.values())
    by: dict[int, list] = {}
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(16))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 16) <= longest


def test_splitters_are_exact(spark):
    sizes = [(i * 37 % 1009, 1 + i % 5) for i in range(1000)]
    light = spark.createDataFrame(sizes, "key long, size long")
    total = sum(s for _, s in sizes)
    for probes in (2, 7, 512):
        borders = byte_splitters(light, 7, probes, 0.0)
        assert borders == sorted(borders)
        for i, b in enumerate(borders, 1):
            assert abs(sum(s for k, s in sizes if k < b) - i * total / 7) <= 5


def test_odd_shards(odd):
    rows, df = odd
    out = shard_by_bytes(df, 4, "id", "text").collect()
    assert Counter(r["size"] for r in out) == Counter(len((t or "").encode()) + 1 for _, t, *_ in rows)
    for s in {r["shard"] for r in out}:
        mine = sorted(r["slot"] for r in out if r["shard"] == s)
        assert mine == list(range(len(mine)))


def test_odd_lines(odd):
    rows, df = odd
    documents = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, gone = set(), set()
    for i, t in documents:
        lines = t.split("\n")
        for j in range(len(lines) - 2):
            w = tuple(lines[j : j + 3])
            if w in seen:
                gone |= {(i, t, j + k) for k in range(3)}
            seen.add(w)
    want = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        want[i, len(lines), "\n".join(x for j, x in enumerate(lines) if (i, t or "", j) not in gone)] += 1
    got = drop_repeated_lines(df, "id", "text").collect()
    assert Counter((r["id"], r["n_lines"], r["text"]) for r in got) == want


def test_text_of_many_lines(spark):
    """Two copies of 60,000 lines of which the second has every hundredth line of its own."""
    lines = [f"line {i}" for i in range(60_000)]
    other = [f"own {i}" if i % 100 == 50 else x for i, x in enumerate(lines)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other))], "id long, text string")
    begun = time.time()
    got = {r["id"]: r for r in drop_repeated_lines(df, "id", "text").collect()}
    assert got[1]["text"] == "\n".join(lines) and got[1]["removed"] == []
    assert got[2]["text"] == "\n".join(x for x in other if x.startswith("own"))
    assert got[2]["removed"] == [i for i in range(60_000) if i % 100 != 50]
    assert time.time() - begun < 30


def test_empty_tables(odd):
    none = odd[1].limit(0)
    assert exact_groups(none, "id", "text").collect() == []
    assert exact_distinct(none, "id", "text").collect() == []
    assert shard_by_bytes(none, 4, "id", "text").collect() == []
    assert repeated_lines(none, "id", "text").collect() == [] and drop_repeated_lines(none, "id", "text").collect() == []
