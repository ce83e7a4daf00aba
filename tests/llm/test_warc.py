"""Archives give back what was written, and the index is in global order."""

import hashlib
import heapq
import random

from pyspark.sql import functions as F

from tallymark.llm import warc
from tallymark.llm.queries import op5_warc

SF = "/root/testdata/sf0.001"


def brute(rows, least=100):
    first = {}
    for i, body in rows:
        if i is not None and len(body) >= least:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, body in rows:
        f = first.get(body) if i is not None else None
        again = f is not None and f != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_pages_agree_with_brute_force(spark):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = op5_warc(spark, SF).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert all(r["intact"] for r in got)


def test_odd_pages(spark):
    bodies = ["", None, "x\r\n\r\ny" * 50, "short", "short", "é" * 60, "é" * 60, "\r\n", "z" * 400_000, "é" * 60, "WARC/1.1\r\n\r\n" * 20]
    rows = [(i, f"http://a.b/{i % 3}\n", b, "p") for i, b in enumerate(bodies)]
    rows += [(None, None, "é" * 60, "p"), (None, "//H.com", "n" * 200, "p"), (5, "http://a.b/2\n", "é" * 60, "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, archive string")
    index = warc.archive_and_index(df, F.timestamp_seconds(F.coalesce("id", F.lit(0))))
    got = [(None if r["id"] is None else int(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in index.collect()]
    assert sorted(got, key=str) == brute([(i, (b or "").encode()) for i, _, b, _ in rows])
    assert warc.archive_and_index(df.limit(0), F.current_timestamp()).collect() == []


def test_index_is_in_global_order(spark):
    rows = [(f"k{random.Random(i).randrange(50):03}", f"t{i % 7}", f"a{i % 5}", i) for i in range(3000)]
    out = warc.merged_index(spark.createDataFrame(rows, "url_key string, captured string, archive string, at long"), range_rows=400)
    got = [(r["url_key"], r["captured"], r["archive"], r["at"]) for r in sorted(out.collect(), key=lambda r: (r["span"], r["position"]))]
    assert got == sorted(rows)


def test_loser_tree():
    draw = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(draw.choices(range(40), k=draw.randrange(12))) for _ in range(k)]
        assert list(warc.merge_runs(runs)) == list(heapq.merge(*runs))


def test_url_key():
    assert warc.url_key("https://u@WWW.Example.org:80/a?b") == "org:80,example,www)/a?b"
    assert warc.url_key("") == ")/"
