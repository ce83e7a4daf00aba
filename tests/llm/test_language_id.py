"""Languages of held-out documents, and rows without a language."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallymark.llm import language_id as li
from tallymark.llm.queries import op7_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op7_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]
    assert len(held) > 200 and np.mean(right) > 0.98
    assert abs(np.mean([r["score"] for r in held]) - np.mean(right)) < 0.03


@pytest.fixture(scope="module")
def model(spark):
    rows = [("en", f"the house and the garden {i} of them") for i in range(40)] + [("de", f"das Haus und der Garten {i} von denen") for i in range(40)]
    rows += [(None, "x y z"), ("en", None)]
    return li.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string"), fit_rows=60)


def test_rows_without_a_language(spark, model):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "123 !? \n", 0.5), (4, "the garden", 0.5), (4, "the garden", 0.5), (None, "der Garten", 0.5), (6, "日本", 0.5), (7, "das " * 100_000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = [tuple(r)[:2] for r in li.predict(df, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (6, got[6][1]), (7, "de")], key=str)
    assert got[6][1] in ("de", "en")
    assert li.predict(df.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    empty = li.fit(none)
    assert empty.languages == ()
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [tuple(r) for r in li.predict(df, empty).collect()] == [(1, "und", 0.0)]
    one = li.fit(spark.createDataFrame([(1, "en", "some text")], "doc_id long, lang string, text string"))
    assert [tuple(r) for r in li.predict(df, one).collect()] == [(1, "en", 1.0)]


def test_penalty_leaves_weights_at_zero():
    samples = [(np.array([1]), np.array([1.0])), (np.array([2]), np.array([1.0]))] * 50
    labels = np.array([0, 1] * 50)
    weights, _ = li.fit_ftrl(samples, labels, 2)
    assert np.count_nonzero(weights) == 4 and weights[1, 0] > 0 > weights[1, 1]


def test_temperature_softens_wrong_certainty():
    logits = np.array([[9.0, 0.0]] * 10)
    assert li.calibrate(logits, np.array([0] * 6 + [1] * 4)) > 5
    assert li.calibrate(logits, np.zeros(10, dtype=int)) < 1


def plain_grams(text):
    """Bucket counts of one to three characters, one number at a time."""
    word = [ord(c) for c in text.lower()]
    word = [c if 97 <= c <= 122 or (c >= 0xC0 and c not in (0xD7, 0xF7) and not 0x2000 <= c <= 0x206F) else 32 for c in word]
    run = [32]
    for c in [*word, 32]:
        if c != 32 or run[-1] != 32:
            run.append(c)
    factors, found = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), Counter()
    for size in (1, 2, 3):
        for i in range(len(run) - size + 1):
            if size == 1 and run[i] == 32:
                continue
            h = (sum(c * f for c, f in zip(run[i : i + size], factors)) + size - 1) % 2**32
            found[((h ^ (h >> 15)) * 0x2C1B3C6D % 2**32) >> 17] += 1
    return found


def plain_features(text, idf):
    x = {b: (1 + math.log(n)) * idf[b] for b, n in plain_grams(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {b: v / norm for b, v in x.items()} if norm else x


def plain_shares(scores):
    e = [math.exp(s - max(scores)) for s in scores]
    return [v / sum(e) for v in e]


def test_training_and_predictions_agree_with_dictionaries(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] and r["lang"]][:240]
    learned = spark.createDataFrame([(r["doc_id"], r["lang"], r["text"]) for r in docs], "doc_id long, lang string, text string")
    model = li.fit(learned)
    langs = model.languages

    # Follow-the-regularised-leader, weight by weight.
    rows = [plain_features(r["text"], model.idf) for r in docs[:60]]
    labels = np.array([langs.index(r["lang"]) for r in docs[:60]])
    samples = [(np.array(sorted(x)), np.array([x[b] for b in sorted(x)])) for x in rows]
    weights, bias = li.fit_ftrl(samples, labels, len(langs), epochs=2)
    z, n = {}, {}

    def weight(key):
        zk, nk = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(zk) <= li.L1 else (math.copysign(li.L1, zk) - zk) / ((li.BETA + math.sqrt(nk)) / li.ALPHA + li.L2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            x = {**rows[i], "bias": 1.0}
            now = {(b, c): weight((b, c)) for b in x for c in range(len(langs))}
            p = plain_shares([sum(v * now[b, c] for b, v in x.items()) for c in range(len(langs))])
            for b, v in x.items():
                for c in range(len(langs)):
                    g, old = v * (p[c] - (c == labels[i])), n.get((b, c), 0.0)
                    z[b, c] = z.get((b, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / li.ALPHA * now[b, c]
                    n[b, c] = old + g * g
    for b, c in list(z):
        assert (bias[c] if b == "bias" else weights[b, c]) == pytest.approx(weight((b, c)), abs=1e-9)

    # Predictions by the model's weights.
    got = {r["doc_id"]: r for r in li.predict(learned, model).collect()}
    for r in docs:
        x = plain_features(r["text"], model.idf)
        p = plain_shares([(sum(v * model.weights[b, c] for b, v in x.items()) + model.bias[c]) / model.temperature for c in range(len(langs))])
        assert got[r["doc_id"]]["score"] == pytest.approx(max(p), abs=1e-9)
        assert got[r["doc_id"]]["lang_pred"] == langs[p.index(max(p))]
