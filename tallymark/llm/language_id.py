"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased letters (anything else separates
words) are hashed into a fixed number of buckets.  Document frequencies are
counted over all labelled documents.  The regression is fitted with
follow-the-regularised-leader under an elastic-net penalty, on a sample of
labelled documents whose size is the parameter ``fit_rows`` (equal shares of
the languages), and its probabilities are calibrated by one temperature on the
part of the sample that the fit has not seen.  Prediction covers every text.

Defined cases: a null text and a text without a letter get ``und`` with score 0.
Without labelled documents every answer is ``und``.  Null labels are not
learned.  Repeated rows get equal answers.  Among equal probabilities the first
language in alphabetical order wins.  Columns not named are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import stored

BUCKETS = 1 << 15
#: Labelled documents that the fit sees at most.
FIT_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_SHIFT = np.uint32(32 - 15)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, in order, and how often each occurs."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = ((code >= 97) & (code <= 122)) | ((code >= 0xC0) & (code != 0xD7) & (code != 0xF7) & ((code < 0x2000) | (code > 0x206F)))
    code = np.concatenate(([32], np.where(letter, code, 32), [32])).astype(np.uint32)
    # Runs of separators count once.
    code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
    total = np.zeros(BUCKETS, dtype=np.int64)
    one = code * _MULTIPLIERS[0]
    two = one[:-1] + code[1:] * _MULTIPLIERS[1]
    three = two[:-1] + code[2:] * _MULTIPLIERS[2]
    for n, grams in enumerate((one[code != 32], two, three)):
        grams = grams + np.uint32(n)
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        total += np.bincount(grams >> _SHIFT, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.int32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray  # by bucket
    weights: np.ndarray  # bucket by language
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = weigh(at, counts, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or _LETTER.search(text) is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*gram_counts(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[at]
    norm = np.sqrt(np.dot(x, x))
    return x / norm if norm > 0 else x


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(samples: list, labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket by class) and bias. Each sample is a pair of buckets and weights."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def solve(zs, ns):
        w = (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) > L1, w, 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(samples)):
            at, x = samples[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = solve(zs, ns)
            gap = softmax(x @ w)
            gap[labels[i]] -= 1.0
            g = np.outer(x, gap)
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
    w = solve(z, n)
    return w[:BUCKETS], w[BUCKETS]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by narrowing a bracket."""
    if len(labels) == 0:
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS
) -> LanguageModel:
    """Fit on the given rows; rows without a label are not used."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")
    )
    per_language = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(per_language))
    if not languages:
        return LanguageModel((), np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    quota = max(1, fit_rows // len(languages))
    # Cut points are generous; the exact number is taken by order below.
    cut = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, 1.3 * quota / per_language[k] + 0.001))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)).alias("draw")
    marked = rows.select("lang", "text", draw).select("lang", "text", "draw", (F.col("draw") < cut[F.col("lang")] * 1_000_003).alias("pick"))

    def count(batches):
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            out = {"lang": [], "draw": [], "at": [], "counts": []}
            for lang, text, draw, pick in zip(*(batch.column(i) for i in range(4)), strict=True):
                at, counts = gram_counts(text.as_py())
                seen[at] += 1
                if pick.as_py():
                    for k, v in (("lang", lang.as_py()), ("draw", draw.as_py()), ("at", at.tobytes()), ("counts", counts.tobytes())):
                        out[k].append(v)
            yield _counted(**out)
        at = np.flatnonzero(seen)
        yield _counted(bucket=at.astype(np.int32), n=seen[at])

    counted = stored(marked.mapInArrow(count, "lang string, draw long, at binary, counts binary, bucket int, n long"))
    frequency = np.zeros(BUCKETS)
    for r in counted.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequency[r["bucket"]] = r["n"]
    idf = np.log((1.0 + sum(per_language.values())) / (1.0 + frequency)) + 1.0
    samples, labels = [], []
    for i, lang in enumerate(languages):
        taken = counted.where((F.col("lang") == lang)).orderBy("draw", "at", "counts").limit(quota)
        for r in taken.select("at", "counts").collect():
            at = np.frombuffer(r["at"], dtype=np.int32)
            samples.append((at, weigh(at, np.frombuffer(r["counts"], dtype=np.int32), idf)))
            labels.append(i)
    labels = np.array(labels)
    # Every fifth sample of a language serves the calibration.
    held = np.arange(len(samples)) % 5 == 4
    fitted = [s for s, h in zip(samples, held, strict=True) if not h]
    weights, bias = fit_ftrl(fitted, labels[~held], len(languages))
    logits = np.array([x @ weights[at] + bias for (at, x), h in zip(samples, held, strict=True) if h]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, bias, calibrate(logits, labels[held]))


def _counted(lang=(), draw=(), at=(), counts=(), bucket=(), n=()) -> pa.RecordBatch:
    size = max(len(lang), len(bucket))

    def column(values, kind):
        return pa.array(values, kind) if len(values) else pa.nulls(size, kind)

    return pa.record_batch(
        {
            "lang": column(lang, pa.string()),
            "draw": column(draw, pa.int64()),
            "at": column(at, pa.binary()),
            "counts": column(counts, pa.binary()),
            "bucket": column(bucket, pa.int32()),
            "n": column(n, pa.int64()),
        }
    )


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with ``lang_pred`` and ``score``, for every row.

    A kept column that has one of these two names comes back with ``kept_`` before it.
    """
    names = [f"kept_{c}" if c in ("lang_pred", "score") else c for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the buckets and languages
    rows = docs.select(*keep, *([] if text_col in keep else [text_col]))
    at = rows.columns.index(text_col)

    def label(batches):
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            kept = pa.record_batch(batch.columns[: len(keep)], names=names)
            yield kept.append_column("lang_pred", pa.array([x for x, _ in found], pa.string())).append_column(
                "score", pa.array([s for _, s in found], pa.float64())
            )

    fields = ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    return rows.mapInArrow(label, f"{fields}, lang_pred string, score double")
