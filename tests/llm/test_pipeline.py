"""Each stage agrees with a brute-force version on what the stage before it kept."""

import base64
import hashlib
import re
import sys

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from tallymark.llm.decontaminate import budget, least_edits, normal  # noqa: E402
from tallymark.session import stored  # noqa: E402
from tests.llm.test_minhash import brute as near  # noqa: E402

SF = "/root/testdata/sf0.001"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "1234 !! 99", "en", "s", 10), (9003, "", None, "s", 0), (None, None, None, None, None)]
    extra = spark.createDataFrame(extra, docs.schema)
    out = [docs.union(extra)]
    for name, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert len(pipeline.STAGES) == 5


def test_language_rejects_only_text_without_letters(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert after == {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}


def test_exact(steps):
    before, best = rows(steps[1]), {}
    for i, t in before.items():
        best[fold(t)] = max(i, best.get(fold(t), i))
    assert rows(steps[2]) == {i: before[i] for i in best.values()}


def test_near(steps):
    before = rows(steps[2])
    assert rows(steps[3]) == {i: before[i] for i, (_, _, kept) in near(before.items(), 5).items() if kept}


def test_leaks(spark, steps):
    before = rows(steps[3])
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in before.items() if all(least_edits(q, normal(t)) > budget(len(q)) for q in items)}
    assert rows(steps[4]) == clean and len(clean) < len(before)


def test_tokens(steps):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, got = rows(steps[4]), steps[5].collect()
    assert len(got) == len(before)
    for r in got:
        assert r["ids"] == library.encode_ordinary(before[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest()


def test_run(spark, steps):
    assert pipeline.run(spark, SF).count() == steps[5].count()


def test_module_names_are_plain():
    assert all(re.fullmatch(r"\w+", n) for n, _ in pipeline.STAGES)


CLASHING = ["id", "k_id", "k_version", "_null", "score", "lang_pred", "text_", "row", "version", "size", "key", "carried", "sha256", "block"]


def test_clashing_columns_pass_through(spark, steps):
    docs = steps[0]
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    for n, (_, stage) in enumerate(pipeline.STAGES, 1):
        docs = stored(stage(spark, docs, SF))
        if n < len(pipeline.STAGES):
            assert docs.columns == [*steps[0].columns, *CLASHING]
            found = docs.collect()
            assert all(r[name] == f"{i}:{r['doc_id']}" for r in found for i, name in enumerate(CLASHING))
            assert {r["doc_id"]: r["text"] for r in found} == rows(steps[n])
    assert {tuple(r) for r in docs.select("doc_id", "ids_sha256").collect()} == {tuple(r) for r in steps[-1].select("doc_id", "ids_sha256").collect()}


def test_an_empty_table(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() == 0
