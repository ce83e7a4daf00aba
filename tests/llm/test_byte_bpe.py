"""Encoding agrees with the tokenizer library on every document and decodes to the input bytes."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from tallymark.llm import byte_bpe
from tallymark.llm.queries import op10_byte_bpe

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_documents_agree_with_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op10_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(",".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode())


def test_odd_texts(spark, library):
    texts = [None, "", " ", "\n\n  \t x", "a" * 5000, "ab" * 3000 + " é" * 500, "\x1c\x1d \x85 　x ", "I'll we'Re don't", "日本語 テキスト 😀😀", "١٢٣ ½ ²", "\x00 nul", "a\r\nb   ", "'s'", "same", "same"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(13, "same", 2), (None, "x y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN, block_bytes=2000), RANKS).collect()
    got = sorted((r["id"] if r["id"] is not None else -1, tuple(r["ids"]), bytes(r["decoded"])) for r in coded)
    want = sorted((-1 if i is None else i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect() == []
