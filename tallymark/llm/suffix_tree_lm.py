"""Language model scoring with a probabilistic suffix tree over words.

The tree's states are contexts of one to ``DEPTH`` words.  A context is a
candidate when at least ``LEAST_COUNT`` tokens of the training documents follow
it, whatever the size of the corpus.  A candidate is retained when its next-word
distribution diverges from the one of its suffix (the context without its first
word) by more than ``DIVERGENCE`` (Kullback-Leibler, less the bias of counting).
Distributions are smoothed towards the next shorter state (Witten-Bell), at the
root by adding one to each count with one place for unknown words.  A token is
scored by the longest retained suffix of the words before it.

Candidates are found depth by depth, because a context is never more frequent
than any part of it: words are counted first, then what follows frequent words,
then what follows frequent pairs, and so on.  What follows a context is the
count of the next longer context, so one exchange serves both.  In an exchange
every block of documents sends its distinct keys, with their counts, to the part
that owns them and gets the corpus-wide counts back.  A frequent key costs one
entry per block.

Keys are small.  A part numbers the words and the frequent contexts that it
owns, so a context and the word after it are one number below contexts times
words, not a hash of 64 bits; numbers are scattered by a bijection, so what
follows a frequent context is spread over all parts.  A place whose word never
follows the shorter context asks nothing, for its count is 0.  Of the blocks
that hold a key, one counts it as a kind of token after its context and adds the
kind's part of the divergence; blocks exchange one row per context.

Counts are exact and cover all training documents.  Tokens stay in their bucket
of blocks throughout; only totals come to the driver.

Words are the runs of bytes other than space and 0x09-0x0D with A-Z folded, each
known by a 64-bit hash; every text ends with an end token.

Defined cases: a null text is the end token alone.  Without training documents
every word is unknown.  Rows with a null training mark are not learned from.
Repeated rows count each time and get equal scores.  A text of any length is
read whole and lies in one block.  An empty table gives an empty result.
Columns not named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.blocks import pack, unpack
from tallymark.llm.words import fold, hash_many, mix
from tallymark.session import fresh_path, passed_on

DEPTH = 4
LEAST_COUNT = 40
DIVERGENCE = 0.02
#: Bytes of text in a block, about: the larger, the fewer blocks send the same key.
BLOCK = 16 << 20
#: Files of blocks that no exchange moves again; beyond so many blocks a bucket holds several, one of which is worked on at a time.
MOST_BUCKETS = 20_000
END = mix(np.array([0xE0D], dtype=np.uint64))[0]
def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end token, and where each begins."""
    words, begin = hash_many([fold(t) for t in texts])
    return np.insert(words, begin[1:], END), begin + np.arange(len(begin))


def _shut(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, so that high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes()) if len(numbers) else b""


def _open(packed: bytes, kind=np.int64) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
    return np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def _shut_keys(keys: np.ndarray) -> bytes:
    """Keys in order, as differences."""
    return _shut(np.diff(keys, prepend=np.uint64(0)))


def _open_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_open(packed, np.uint64), dtype=np.uint64)


def _narrow(n: np.ndarray) -> np.ndarray:
    """The counts in half the memory where they are small enough."""
    return n.astype(np.int32) if n.max(initial=0) < 1 << 31 else n


def _share(size: int, parts: int) -> int:
    """How many values a part owns of the keys made of numbers below ``size``."""
    return -(-(1 << max(1, size - 1).bit_length()) // parts)


def _keys(numbers: np.ndarray, size: int, parts: int, start: int, width: int) -> np.ndarray:
    """Keys of numbers below ``size``: scattered by a bijection, dealt to the parts, and counted from ``start`` among the ``width`` keys of a part."""
    bits = max(1, size - 1).bit_length()
    if max(1 << bits, parts * width) >> 63:
        raise OverflowError(f"keys of {bits} bits")
    keep, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        numbers = ((numbers ^ (numbers >> half)) * np.uint64(factor)) & keep
    part, rest = np.divmod(numbers, np.uint64(_share(size, parts)))
    return part * np.uint64(width) + np.uint64(start) + rest


@dataclass(frozen=True)
class Numbers:
    """How many numbers the parts have given: to words too rare to be a context, and, by exchange, to frequent keys."""

    parts: int
    rare: int
    often: Sequence[int]


@dataclass(frozen=True)
class Answer:
    """What the corpus holds of a block's keys, in their order."""

    n: np.ndarray  # twice the count, and one more if this block counts the key
    rare: np.ndarray  # numbers of the words that occur but are no candidates
    often: np.ndarray  # numbers of the keys that are candidates as a context


class Block:
    """Tokens of a block with all that the exchanges so far have answered.

    Exchange ``d`` is about ``d`` words and the word after them: ``key[d]`` has
    the key that a place asked for (-1 if none), ``n[d]`` the count of each key
    (and a 0 for -1), ``counted[d]`` the keys that this block counts, ``often[d]``
    those that are candidates as a context of ``d + 1`` words and ``number[d]``
    their numbers. ``alive[d]`` marks the places after a candidate of ``d``
    words. ``asked`` and ``asked_n`` are the keys of the next exchange, in order,
    and their counts in this block; a part owns ``width`` values of them.
    """

    def __init__(self, row: dict, answers: Sequence[Answer], depth: int, least: int, given: Numbers):
        docs = unpack(row["docs"])
        self.ids, self.sizes = docs.column("id"), docs.column("size").to_numpy()
        word = _by_class(_open(row["classes"], np.uint8))[_open(row["tokens"], np.int32)]
        self.least, self.given = least, given
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))
        self.offset = (np.arange(len(word)) - np.repeat(self.begin[:-1], self.sizes)).astype(np.int32)
        self.trained = np.repeat(docs.column("trained").to_numpy(zero_copy_only=False).astype(bool), self.sizes)
        self.key = [word]
        self.n: list[np.ndarray] = []
        self.counted, self.often, self.number = [], [], []
        self.alive = [np.ones(len(word), dtype=bool)]
        for d, answer in enumerate(answers, 1):
            n = _narrow(answer.n >> 1)
            self.n.append(np.append(n, n.dtype.type(0)))
            self.counted.append(np.flatnonzero(answer.n & 1))
            self.often.append(np.flatnonzero(n >= least))
            self.number.append(answer.often)
            if d == 1:
                self.word_number = np.zeros(len(n), dtype=np.uint64)
                self.word_number[(n > 0) & (n < least)] = answer.rare
                self.word_number[self.often[0]] = answer.often
            self.asked, self.asked_n, self.width = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 1
            if d <= depth:
                self._grow(d)

    def _grow(self, d: int) -> None:
        n = self.n[-1][self.key[-1]]
        self.alive.append(np.concatenate(([False], n[:-1] >= self.least)) & (self.offset >= d))
        # A word that never follows the shorter context does not follow the longer one.
        places = np.flatnonzero(self.alive[-1] & (n > 0))
        context = np.zeros(len(self.n[-1]), dtype=np.uint64)
        context[self.often[-1]] = self.number[-1]
        context, word = context[self.key[-1][places - 1]], self.key[0][places]
        # Keys with a frequent word have fewer values, so they lie close together, before the others.
        parts, words = self.given.parts, (self.given.often[0], self.given.rare)
        sizes = [self.given.often[d - 1] * w for w in words]
        start = _share(sizes[0], parts)
        self.width = start + _share(sizes[1], parts)
        rare, keys = self.n[0][word] < self.least, np.empty(len(places), dtype=np.uint64)
        for mask, count, size, first in zip((~rare, rare), words, sizes, (0, start), strict=True):
            keys[mask] = _keys(context[mask] * np.uint64(count) + self.word_number[word[mask]], size, parts, first, self.width)
        self.asked, key = np.unique(keys, return_inverse=True)
        self.asked_n = np.bincount(key[self.trained[places]], minlength=len(self.asked)).astype(np.int64)
        self.key.append(np.full(len(n), -1, dtype=np.int32))
        self.key[-1][places] = key

    def candidates(self, d: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys of the candidates of ``d`` words, in order, the candidate of each, and how many values a part owns."""
        size, parts = self.given.often[d - 1], self.given.parts
        keys = _keys(self.number[d - 1], size, parts, 0, width := _share(size, parts))
        order = np.argsort(keys)
        return keys[order], order, width

    def sums(self, d: int, total: int) -> tuple[np.ndarray, ...]:
        """Per candidate of ``d`` words: tokens after it in the corpus (0 if this block does not count it), the kinds after it that this block counts, and their share of the divergence."""
        place = np.zeros(len(self.n[d]), dtype=np.int64)
        place[self.key[d]] = np.arange(len(self.key[d]))
        at, n = place[self.counted[d]], self.n[d][self.counted[d]].astype(float)
        context = self.key[d - 1][at - 1]
        shorter = total if d == 1 else self.n[d - 2][self.key[d - 2][at - 1]]
        # A word after a context also follows the context's suffix.
        gain = n * np.log(n / self.n[d - 1][context] / (self.n[d - 1][self.key[d - 1][at]] / shorter))
        told = np.zeros(len(self.n[d - 1]), dtype=np.int64)
        told[self.counted[d - 1]] = self.n[d - 1][self.counted[d - 1]]
        kinds, gain = (np.bincount(context, weights=w, minlength=len(told))[self.often[d - 1]] for w in (None, gain))
        return told[self.often[d - 1]], kinds, gain.astype(np.float32)

    def scores(self, total: int, kinds: int, chosen: Sequence[np.ndarray]) -> pa.Table:
        """Log10 probabilities by the root alone and by the tree; ``chosen`` has, by depth, the kinds of each candidate in the order of keys, 0 if not retained."""
        n = self.n[0][self.key[0]]
        base = (n + 1) / (total + kinds + 1)
        p = base.copy()
        for d in range(1, len(self.n)):
            kept = np.zeros(len(self.n[d - 1]), dtype=np.int64)
            kept[self.often[d - 1][self.candidates(d)[1]]] = chosen[d - 1]
            at = np.flatnonzero(self.alive[d])
            context = self.key[d - 1][at - 1]
            at, context = at[kept[context] > 0], context[kept[context] > 0]
            here = kept[context]
            p[at] = (self.n[d][self.key[d][at]] + here * p[at]) / (self.n[d - 1][context] + here)
        first = self.begin[:-1]
        return pa.table(
            {
                "id": self.ids,
                "n_tokens": pa.array(self.sizes),
                "n_known": pa.array(np.add.reduceat((n > 0).astype(np.int64), first)),
                "base_score": pa.array(np.add.reduceat(np.log10(base), first)),
                "score": pa.array(np.add.reduceat(np.log10(p), first)),
            }
        )


def _by_class(classes: np.ndarray) -> np.ndarray:
    """The words of a block from the most frequent class on, so that low numbers are frequent."""
    return np.argsort(np.uint8(255) - classes, kind="stable").astype(np.int32)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Parts, which are in order, and where they lie."""
    owners, first = np.unique(part, return_index=True)
    bounds = np.append(first, len(part))
    for owner, start, stop in zip(owners, bounds[:-1], bounds[1:], strict=True):
        yield int(owner), slice(start, stop)


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


_SENT = "block long, part int, keys binary, n binary, contexts binary, tokens binary, kinds binary, gain binary"
_WORDS_SENT = "block long, part int, keys binary, n binary"


def _blocks(docs: DataFrame, block_bytes: int, parts: int) -> tuple[DataFrame, DataFrame, str]:
    """Blocks of about so many bytes of text, from ``id, text, trained``: packed documents and tokens, the words sent to parts, and where these lie.

    The table is bucketed by block, so that no exchange moves it again.
    """

    def lay(batches):
        task, number = TaskContext.get().partitionId(), 0
        rows, held = [], 0

        def packed():
            ids, texts, trained = zip(*rows, strict=True)
            tokens, begin = tokens_of(list(texts))
            words, word, count = np.unique(tokens, return_inverse=True, return_counts=True)
            of = pack(id=pa.array(ids, kind), trained=pa.array(trained, pa.bool_()), size=pa.array(np.diff(begin)))
            n = np.bincount(word[np.repeat(np.array(trained, dtype=bool), np.diff(begin))], minlength=len(words)).astype(np.int64)
            classes = np.frexp(count)[1].astype(np.uint8)
            order = _by_class(classes)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order), dtype=np.int32)
            block, owner = (task << 32) + number, ((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            out = [(block, part, _shut_keys(words[s]), _shut(n[s]), None, None, None, "words") for part, s in _by_part(owner)]
            out.append((block, None, None, None, of, _shut(classes), _shut(rank[word]), "tokens"))
            form = {"keys": pa.binary(), "n": pa.binary(), "docs": pa.binary(), "classes": pa.binary(), "tokens": pa.binary(), "kind": pa.string()}
            yield from _table(out, block=pa.int64(), part=pa.int32(), **form).to_batches()

        for batch in batches:
            kind = batch.column(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append(row)
                held += len(row[1] or "")
                if held >= block_bytes:
                    yield from packed()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield from packed()

    spark, name, path = docs.sparkSession, f"tallymark_{uuid4().hex}", fresh_path(docs.sparkSession)
    laid = docs.mapInArrow(lay, f"{_WORDS_SENT}, docs binary, classes binary, tokens binary, kind string").write.format("parquet").partitionBy("kind")
    laid.bucketBy(min(parts, MOST_BUCKETS), "block").option("path", path).saveAsTable(name)
    table = spark.table(name)
    blocks = table.where("kind = 'tokens'").select("block", "docs", "classes", "tokens")
    return blocks, table.where("kind = 'words'").select("block", "part", "keys", "n"), f"{path}/kind=words"


_ANSWERS = "block long, part int, n binary, rare binary, often binary, chosen binary, kinds long, total long, most_rare long, most_often long, states long"


def _answered(step: int, sent: DataFrame, least: float, divergence: float) -> DataFrame:
    """Corpus-wide counts of the keys of every block, in their order, and a part's numbers of rare words and of frequent keys; the kinds of the candidates of every block, 0 for those that are not retained. A row without a block has the part's totals.

    Counts are doubled; of the blocks whose training documents hold a key, the one with the lowest number gets one more.
    """

    def joined(rows, column, kind=None):
        found = [_open_keys(x.as_py()) if kind is None else _open(x.as_py(), kind) for x in rows.column(column)]
        return np.concatenate(found), np.cumsum([len(x) for x in found])[:-1]

    def count(rows):
        keys, ends = joined(rows, "keys")
        distinct, place = np.unique(keys, return_inverse=True)
        counts, _ = joined(rows, "n", np.int64)
        n = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
        held = np.flatnonzero(counts)
        mark = np.zeros_like(counts)
        mark[held[np.unique(place[held], return_index=True)[1]]] = 1
        rare, often = (n > 0) & (n < least) & (step == 0), n >= least
        split = [[_shut(x) for x in np.split(2 * n[place] + mark, ends)]]
        for mask in (rare, often):
            number = np.cumsum(mask, dtype=np.uint64) - np.uint64(1)
            split.append([_shut_keys(number[at[mask[at]]]) for at in np.split(place, ends)])
        return split, (np.count_nonzero(n), n.sum(), np.count_nonzero(rare), np.count_nonzero(often))

    def decide(rows):
        keys, ends = joined(rows, "contexts")
        distinct, place = np.unique(keys, return_inverse=True)
        sums = (joined(rows, column, kind)[0] for column, kind in (("tokens", np.int64), ("kinds", np.int64), ("gain", np.float32)))
        tokens, kinds, gain = (np.bincount(place, weights=x, minlength=len(distinct)) for x in sums)
        kinds = np.where(gain - (kinds - 1) / 2 >= divergence * tokens, kinds, 0).astype(np.int64)
        return [_shut(x) for x in np.split(kinds[place], ends)], np.count_nonzero(kinds)

    def add_up(key, rows):
        # Always in one order, so that sums do not depend on the exchange.
        rows = rows.sort_by("block")
        counted, totals = count(rows)
        chosen, states = decide(rows) if step > 1 else ([None] * len(rows), 0)
        out = [(b, key[0].as_py(), *found, *[None] * 5) for b, *found in zip(rows.column("block").to_pylist(), *counted, chosen, strict=True)]
        out.append((None, key[0].as_py(), *[None] * 4, *totals, states))
        binary = {c: pa.binary() for c in ("n", "rare", "often", "chosen")}
        whole = {c: pa.int64() for c in ("kinds", "total", "most_rare", "most_often", "states")}
        return _table(out, block=pa.int64(), part=pa.int32(), **binary, **whole)

    return passed_on(sent.groupBy("part").applyInArrow(add_up, _ANSWERS).withColumn("step", F.lit(step)))


def _totals(answers: DataFrame) -> tuple[int, ...]:
    """Kinds, tokens, the most rare words and the most frequent keys that a part numbers, and states."""
    sums = F.sum("kinds"), F.sum("total"), F.max("most_rare"), F.max("most_often"), F.sum("states")
    return tuple(x or 0 for x in answers.agg(*sums).first())


@dataclass(frozen=True)
class Scored:
    rows: DataFrame  # id, n_tokens, n_known, base_score, score
    tokens: int  # of the training documents
    kinds: int  # distinct ones of them
    states: int


def score_corpus(
    docs: DataFrame,
    trained: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    least_count: int = LEAST_COUNT,
    divergence: float = DIVERGENCE,
    block_bytes: int = BLOCK,
) -> Scored:
    """Learn from the documents that ``trained`` marks and score all: log10 probabilities by the root alone and by the tree."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    blocks, sent, words_path = _blocks(rows, block_bytes, parts)
    known: list[DataFrame] = []

    def opened(block: pa.Table, held: pa.Table) -> tuple[Block, list[np.ndarray]]:
        """A block and what was chosen of its candidates, by depth."""
        held = held.sort_by([("step", "ascending"), ("part", "ascending")])
        steps, owners = held.column("step").to_numpy(), held.column("part").to_pylist()

        def joined(step, column, numbers=None):
            found = [np.zeros(0, dtype=np.int64 if numbers is None else np.uint64)]
            for i in np.flatnonzero(steps == step).tolist():
                x = held.column(column)[i].as_py()
                found.append(_open(x) if numbers is None else _open_keys(x) + np.uint64(owners[i] * (numbers // parts)))
            return np.concatenate(found)

        answers = [Answer(joined(d, "n"), joined(d, "rare", given.rare), joined(d, "often", many)) for d, many in enumerate(given.often[: depth + 1])]
        return Block(block.to_pylist()[0], answers, depth, least_count, given), [joined(d + 1, "chosen") for d in range(1, depth + 1)]

    def each(work, form: str) -> DataFrame:
        """``work`` on every block with all answers so far."""
        held = reduce(DataFrame.unionByName, known).where("block is not null").select("block", "part", "step", "n", "rare", "often", "chosen")
        return blocks.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(work, form)

    def ask(block, held):
        number = block.column("block")[0].as_py()
        of, _ = opened(block, held)
        out = {}
        # A key is sent as its distance from the first one of its part.
        for part, s in _by_part(of.asked // np.uint64(of.width)):
            out[part] = [_shut_keys(of.asked[s] - np.uint64(part * of.width)), _shut(of.asked_n[s]), *[None] * 4]
        if step > 1:
            keys, order, width = of.candidates(step - 1)
            columns = [c[order] for c in of.sums(step - 1, total)]
            for part, s in _by_part(keys // np.uint64(width)):
                out.setdefault(part, [None] * 6)[2:] = [_shut_keys(keys[s] - np.uint64(part * width)), *(_shut(c[s]) for c in columns)]
        binary = {c: pa.binary() for c in ("keys", "n", "contexts", "tokens", "kinds", "gain")}
        return _table([(number, part, *x) for part, x in out.items()], block=pa.int64(), part=pa.int32(), **binary)

    def rate(block, held):
        of, chosen = opened(block, held)
        return of.scores(total, kinds, chosen)

    # Contexts have ``depth`` words at most: the last exchange but one numbers no more of them, the last one only chooses.
    states, given = 0, Numbers(parts, 0, ())
    for step in range(depth + 2):
        if step:
            sent = each(ask, _SENT)
        known.append(_answered(step, sent, least_count if step < depth else float("inf"), divergence))
        found = _totals(known[-1])
        if step == 0:
            kinds, total, *_ = found
            # The words are on their way back to the blocks as numbers.
            docs.sparkSession.createDataFrame([], _WORDS_SENT).write.mode("overwrite").parquet(words_path)
        states += found[4]
        given = Numbers(parts, given.rare or parts * found[2], (*given.often, parts * found[3]))
    kind = docs.schema[id_col].dataType.simpleString()
    return Scored(each(rate, f"id {kind}, n_tokens long, n_known long, base_score double, score double"), total, kinds, states)
