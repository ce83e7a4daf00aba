"""Packing agrees with queues walked round by round, and holds every id of every document once."""

import pickle
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import packing
from tallymark.llm.packing import Encoder, Rounds, pack, sequences
from tallymark.llm.queries import op11_packing

SF = "/root/testdata/sf0.001"
VOCABULARY = P.path("word_bpe_49k.json")
END = 2


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]


def walked(totals, weights, room, least):
    """The stream as (queue, token) pairs: every round each queue earns its share and serves whole steps."""
    unit = 1 << 28
    share = [max(1, round(w / sum(weights) * unit)) for w in weights]
    served, owed, stream, earned, rounds = [0] * len(totals), [0] * len(totals), [], [0] * len(totals), 0
    while any(s < t for s, t in zip(served, totals)):
        active = [i for i, t in enumerate(totals) if served[i] < t]
        whole = sum(share[i] for i in active)
        rounds += 1
        ended = False
        for i in active:
            credit = owed[i] + rounds * room * share[i] // whole
            give = min(totals[i], earned[i] + credit - credit % least) - served[i]
            stream += [(i, served[i] + k) for k in range(give)]
            served[i] += give
            ended |= served[i] == totals[i]
        if ended:
            for i in active:
                owed[i] = (owed[i] + rounds * room * share[i] // whole) % least
            earned, rounds = list(served), 0
    return stream


@pytest.mark.parametrize("seed", range(12))
def test_closed_form_is_the_walk(seed):
    rng = random.Random(seed)
    totals = [rng.choice([1, 7, 60, 500, 3000]) + rng.randrange(50) for _ in range(rng.randrange(1, 6))]
    weights = [float(t) for t in totals] if seed % 3 == 0 else [rng.choice([1.0, 2.0, 0.01, 30.0]) for _ in totals]
    room, least = rng.choice([32, 64, 100]), rng.choice([1, 4, 16])
    plan = Rounds(totals, weights, room, least)
    want = {token: at for at, token in enumerate(walked(totals, weights, room, least))}
    assert plan.tokens == sum(totals) == len(want)
    for queue, total in enumerate(totals):
        cuts = sorted({0, total, *(rng.randrange(total + 1) for _ in range(8))})
        start, stop = np.array(cuts[:-1]), np.array(cuts[1:])
        row, token, length, place = plan.place(queue, start, stop)
        got = {}
        for r, t, n, at in zip(row, token, length, place):
            assert start[r] <= t and t + n <= stop[r] and n > 0 and at // room == (at + n - 1) // room
            got |= {(queue, int(t) + k): int(at) + k for k in range(n)}
        assert got == {k: v for k, v in want.items() if k[0] == queue}


def test_every_sequence_has_the_mixture():
    totals, weights, room, least = [400_000, 100_000, 300_000], [5.0, 1.0, 2.0], 4096, 64
    plan = Rounds(totals, weights, room, least)
    served = [np.zeros(sum(totals) // room + 1, dtype=np.int64) for _ in totals]
    for queue, total in enumerate(totals):
        _, _, length, place = plan.place(queue, np.array([0]), np.array([total]))
        np.add.at(served[queue], place // room, length)
    # Until the first queue is empty, at 400,000 / (5/8) tokens of the stream.
    full = int(400_000 / (5 / 8) / room) - 1
    for queue, weight in enumerate(weights):
        off = np.cumsum(served[queue][:full]) - np.arange(1, full + 1) * room * weight / 8
        assert abs(off).max() <= room * weight / 8 + 3 * least


def check(rows, pieces, library, room):
    """Every id of each row is in one piece; the sequences have no gaps."""
    stream, parts = [], {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], dtype="<u4").tolist()
        assert len(ids) == p["length"] > 0 and p["offset"] + p["length"] <= room
        stream.append((p["sequence_id"] * room + p["offset"], p["length"]))
        parts.setdefault((p["id"], p["doc_tokens"]), []).append((p["start"], ids))
    at = 0
    for begin, length in sorted(stream):
        assert begin == at
        at += length
    want = {}
    for i, text in rows:
        ids = library(text)
        want.setdefault((i, len(ids)), []).append(ids)
    assert set(want) == set(parts)
    for key, texts in want.items():
        got = sorted((s, x) for s, ids in parts[key] for s, x in enumerate(ids, s))
        assert got == sorted((s, x) for ids in texts for s, x in enumerate(ids))


def test_documents_agree_with_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = pack(docs, VOCABULARY, END).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], pieces, library, 4096)
    got = op11_packing(spark, SF)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    want = sorted((p["id"], p["start"], p["length"], zlib.crc32(p["ids"]), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in pieces)
    assert sorted(tuple(r[:7]) for r in got.collect()) == want


@pytest.mark.parametrize("queues,weights", [(256, None), (1, None), (2, {"a": 3.0, None: 1.0}), (256, {"b": 1.0, "a": 0.5})])
def test_odd_rows(spark, library, queues, weights):
    texts = [None, "", " \n\t", "I'll we'Re don't", "É é ́x ΑΣ İ", "日本語 テキスト 😀😀", "x" * 20_000, "a b " * 9000, "<|endoftext|> <|x", "\x1c\x1d \x85　x \xa0y", "١٢٣ ½ ²", "same", "same"]
    rows = [(i, t, "ab"[i % 2] if i % 5 else None, 1, b"", 0) for i, t in enumerate(texts)] + [(11, "same", "a", 1, b"", 0), (None, "no name", "c", 1, b"", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, ids binary, start int").repartition(3)
    pieces = pack(docs, VOCABULARY, END, weights, room=64, least=8, queues=queues).collect()
    check([(r[0], r[1]) for r in rows], pieces, library, 64)


def test_words_give_the_ids_of_the_whole_text(library):
    texts = ["Tom's  \"quoted\" (text)... a'b ''s '' 's", "ȩ́ ̧́ x​y", "ſt ﬁ Ⅷ ẞ ŉ", "a\tb\nc\rd\x0be\x0cf", "﻿x 1,234.5", "".join(map(chr, range(256))), "DON'T I'Ll x'Ré 3'd", "größe, naïve; ÉTÉ's ß÷×"]
    for found, text in zip(Encoder(VOCABULARY)(texts), texts):
        assert np.frombuffer(found, dtype="<u4").tolist() == library(text)[:-1]


def test_sequences_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = pack(docs, VOCABULARY, END)
    total = pieces.agg(F.sum("length")).first()[0]
    rows = sequences(pieces, pad_id=1).collect()
    assert all(len(r["ids"]) == 4096 for r in rows) and sum(r["length"] for r in rows) == total
    assert sorted(r["sequence_id"] for r in rows) == list(range(-(-total // 4096)))
    assert sum(r["length"] < 4096 for r in rows) <= 1
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pack(empty, VOCABULARY, END).collect() == []


def test_tasks_of_a_worker_share_one_memory_of_words(library, monkeypatch):
    sent = pickle.dumps(Encoder(VOCABULARY))
    one, two = pickle.loads(sent), pickle.loads(sent)
    assert one is two
    monkeypatch.setattr(packing, "_WORDS", 7)
    texts = ["Ça été où naïve ÀÉÎÕÜ straße señor", "don't stop-it 12 " * 3, "x" * 200, "“Ça” \xad\xa0é \x1c\x85ok", "Ça été Æsir ÿ þorn"] * 2
    for found, text in zip(one(texts), texts):
        assert np.frombuffer(found, dtype="<u4").tolist() == library(text)[:-1]
    assert len(one._known) <= 7
