"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

Every source is a queue of the token ids of its documents, one after another.
In each round a queue earns its target share of one sequence and serves what it
has earned, in steps of ``least`` tokens; what it has earned beyond that is its
deficit and stays with it for the next rounds.  The served tokens form one
stream, which is cut into sequences of ``room`` tokens, so only the last one is
padded.  A queue that runs empty leaves, and the others share the room in
proportion of their targets from the next round on.

What a queue has served before a round is a formula of the round's number, so
nobody has to walk the queues: a task that tokenises documents counts the
tokens of each queue, the counts of earlier tasks are added up, and then every
task places its own documents, with the deficits that all tasks before it leave
to each queue.

Texts are cut into words where the tokenizer's pattern cuts them, and a worker
encodes each distinct word once, which gives the ids of the whole text because
no merge and no normalisation crosses such a cut.

Defined cases: a null or empty text has the end id only.  A null source is a
queue of its own.  The ``queues`` sources with the most tokens have a queue
each and all others share one more: such a source would fill less than a
``queues``-th part of a sequence, so no single sequence could keep its share.
Repeated rows and null identifiers are packed row by row.  A document of any
length is cut as often as needed; one word without white space is encoded in
one piece.  An empty table gives an empty result.  Columns other than the
three named ones are not looked at.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Mapping
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import fresh_path, stored

ROOM = 4096
#: A queue serves multiples of so many tokens, so that a small source is not cut into single tokens.
LEAST = 64
#: Sources with a queue of their own.
QUEUES = 256
#: Target shares are whole multiples of this part.
_UNIT = 1 << 28
#: Words whose ids a worker remembers (twice as many with the older half), and signs of the longest such word.
_WORDS, _LONGEST = 500_000, 64
#: Bytes of text encoded and bytes of ids returned at a time.
_TEXT_BYTES, _ID_BYTES = 1 << 20, 8 << 20
# The tokenizer's pattern for lower-case text of the signs that _SIMPLE allows: all its letters are Latin, all its digits ASCII.
_SIMPLE = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\r0-9a-zß-öø-ÿ]+").findall
_CHUNKS = re.compile(r"[^ \t-\r]+").findall
_PLAIN = re.compile(r"[!-~ß-öø-ÿ]+").fullmatch
# The model's signs for the UTF-8 bytes of a Latin-1 letter: bytes that print in Latin-1 stand for themselves, the others follow from 0x100 on.
_UNSEEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_SIGNS = {c: "".join(chr(0x100 + _UNSEEN.index(b) if b in _UNSEEN else b) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Memory(dict):
    """Answers worked out once; beyond ``_WORDS`` of them the older ones are forgotten unless they are asked for again."""

    def __init__(self, work):
        self.work, self.older = work, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.work(key)
        if len(key) <= _LONGEST:
            if len(self) >= _WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, word by word.

    The words are the matches of the tokenizer's pattern, found here for texts
    of ASCII and Latin-1 letters; of other texts, what stands between white
    space is one word if it holds any other sign.  Words are remembered for as
    long as the worker lives.
    """

    def __init__(self, path: str):
        self.path = path
        self._tokenizer = None
        self._known = _Memory(self._encode)

    def __reduce__(self):
        return _shared, (self.path,)

    def _encode(self, word: str) -> bytes:
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
            self._model = self._tokenizer.model
        if _PLAIN(word):
            return array("I", [t.id for t in self._model.tokenize(word if word.isascii() else word.translate(_SIGNS))]).tobytes()
        return array("I", self._tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()

    def words(self, text: str) -> list[str]:
        if _SIMPLE(text):
            return _PIECES(text.lower())
        found = []
        for chunk in _CHUNKS(text):
            if _SIMPLE(chunk):
                found += _PIECES(chunk.lower())
            else:
                found.append(chunk)
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self._known.__getitem__, self.words(t))) for t in texts]


@cache
def _shared(path: str) -> Encoder:
    """One encoder per worker, whatever the number of its tasks."""
    return Encoder(path)



def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, queue_col: str | None) -> DataFrame:
    """``id, queue, part, at, n, ids`` per row, stored: the queue's tokens of the same part that come before, and the ids as bytes."""
    encode, end = Encoder(tokenizer_path), array("I", [end_id]).tobytes()

    def run(batches):
        part = TaskContext.get().partitionId()
        served: dict[str | None, int] = {}

        def out(rows):
            ids = [r[4] for r in rows]
            return pa.record_batch(
                [
                    pa.array([r[0] for r in rows], id_type),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["id", "queue", "part", "at", "n", "ids"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            texts = batch.column(1)
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            row, ready, size = 0, [], 0
            while row < batch.num_rows:
                stop, taken = row, 0
                while stop < batch.num_rows and (stop == row or taken < _TEXT_BYTES):
                    taken += lengths[stop]
                    stop += 1
                coded = encode([t or "" for t in texts.slice(row, stop - row).to_pylist()])
                ids, queues = batch.column(0).slice(row, stop - row).to_pylist(), batch.column(2).slice(row, stop - row).to_pylist()
                for i, queue, found in zip(ids, queues, coded, strict=True):
                    found += end
                    before, n = served.get(queue, 0), len(found) // 4
                    served[queue] = before + n
                    ready.append((i, queue, before, n, found))
                    size += len(found)
                if size >= _ID_BYTES:
                    yield out(ready)
                    ready, size = [], 0
                row = stop
            if ready:
                yield out(ready)

    queue = F.col(queue_col).cast("string") if queue_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), queue.alias("queue"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, queue string, part int, at long, n long, ids binary")
    path = fresh_path(docs.sparkSession)
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


class Rounds:
    """Where the tokens of the queues come in the stream: deficit round-robin in closed form.

    ``totals`` are the tokens of each queue, ``weights`` its target, in any unit.
    """

    def __init__(self, totals: list[int], weights: list[float], room: int = ROOM, least: int = LEAST):
        self.room, self.least = room, least
        whole = sum(weights)
        share = [max(1, round(w / whole * _UNIT)) if whole else 1 for w in weights]
        served, owed, base = [0] * len(totals), [0] * len(totals), 0
        self.phases = []
        while any(s < t for s, t in zip(served, totals, strict=True)):
            active = [i for i, t in enumerate(totals) if served[i] < t]
            unit = sum(share[i] for i in active)
            earned = [room * share[i] if i in set(active) else 0 for i in range(len(totals))]
            left = [t - s for s, t in zip(served, totals, strict=True)]
            # A queue is empty after the first round in which it has earned all its tokens, in whole steps.
            rounds = min(-(-((-(-left[i] // least)) * least - owed[i]) * unit // earned[i]) for i in active)
            phase = (list(served), list(owed), list(left), earned, unit, base)
            self.phases.append(phase)
            for i in active:
                credit = owed[i] + rounds * earned[i] // unit
                given = min(left[i], credit - credit % least)
                owed[i] = credit % least
                served[i] += given
                base += given
        self.tokens = base
        self._starts = [np.array([p[0][i] for p in self.phases] + [totals[i]], dtype=np.int64) for i in range(len(totals))]

    def _given(self, phase, rounds: np.ndarray, queues) -> np.ndarray:
        """Tokens that each of the queues has served in the phase before the rounds, one column per queue."""
        _, owed, left, earned, unit, _ = phase
        earned, owed, left = (np.array([x[i] for i in queues], dtype=np.int64) for x in (earned, owed, left))
        rounds = rounds[:, None]
        credit = owed + rounds * (earned // unit) + rounds * (earned % unit) // unit
        return np.minimum(left, credit - credit % self.least)

    def _round_of(self, phase, queue: int, token: np.ndarray) -> np.ndarray:
        """The round of the phase in which the queue serves its so many-th token of the phase."""
        need = (token // self.least + 1) * self.least - phase[1][queue]
        earned, unit = phase[3][queue], phase[4]
        guess = np.maximum(np.ceil(need * (unit / earned)).astype(np.int64), 1)
        whole, part = divmod(earned, unit)

        def enough(r):
            return r * whole + r * part // unit >= need

        while (low := ~enough(guess)).any():
            guess += low
        while (high := (guess > 1) & enough(guess - 1)).any():
            guess -= high
        return guess - 1

    def place(self, queue: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first token, length and place in the stream of each piece of the given ranges of a queue."""
        found = []
        first, last = np.searchsorted(self._starts[queue], [start.min(), stop.max() - 1], "right") - 1
        for j in range(first, last + 1):
            begin, end = self._starts[queue][j], self._starts[queue][j + 1]
            row = np.flatnonzero((start < end) & (stop > begin))
            if begin == end or len(row) == 0:
                continue
            phase = self.phases[j]
            low, high = np.maximum(start[row], begin) - begin, np.minimum(stop[row], end) - begin
            # By rounds, or, where a round earns less than a step, by steps: at most about one piece per step either way.
            by_round = phase[3][queue] >= phase[4] * self.least
            if by_round:
                one, two = self._round_of(phase, queue, low), self._round_of(phase, queue, high - 1)
            else:
                one, two = low // self.least, (high - 1) // self.least
            times = two - one + 1
            copy = np.repeat(np.arange(len(row)), times)
            turn = one[copy] + np.arange(len(copy)) - np.repeat(np.cumsum(times) - times, times)
            from_, to = low[copy], high[copy]
            if not by_round:
                from_, to = np.maximum(from_, turn * self.least), np.minimum(to, (turn + 1) * self.least)
                turn = self._round_of(phase, queue, from_)
            turns, which = np.unique(turn, return_inverse=True)
            ahead, mine, next_mine = (np.empty(len(turns), dtype=np.int64) for _ in range(3))
            for at in range(0, len(turns), 4096):
                some = turns[at : at + 4096]
                now = self._given(phase, some, range(len(self._starts)))
                then = self._given(phase, some + 1, range(queue + 1))
                ahead[at : at + 4096] = now.sum(axis=1) + (then[:, :queue] - now[:, :queue]).sum(axis=1)
                mine[at : at + 4096], next_mine[at : at + 4096] = now[:, queue], then[:, queue]
            if by_round:
                from_, to = np.maximum(from_, mine[which]), np.minimum(to, next_mine[which])
            found.append((row[copy], begin + from_, to - from_, phase[5] + ahead[which] + from_ - mine[which]))
        row, token, length, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((token, row))
        return self._cut(row[order], token[order], length[order], place[order])

    def _cut(self, row, token, length, place):
        """Cut the pieces at the ends of sequences, and join those of one row that follow each other inside a sequence."""
        times = (place + length - 1) // self.room - place // self.room + 1
        copy = np.repeat(np.arange(len(row)), times)
        nth = np.arange(len(copy)) - np.repeat(np.cumsum(times) - times, times)
        edge = (place[copy] // self.room + nth) * self.room
        begin = np.maximum(place[copy], edge)
        end = np.minimum(place[copy] + length[copy], edge + self.room)
        row, token = row[copy], token[copy] + begin - place[copy]
        joined = np.zeros(len(row), dtype=bool)
        joined[1:] = (row[1:] == row[:-1]) & (begin[1:] == end[:-1]) & (begin[1:] // self.room == begin[:-1] // self.room)
        head = np.flatnonzero(~joined)
        tail = np.append(head[1:], len(row)) - 1
        return row[head], token[head], end[tail] - begin[head], begin[head]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    weights: Mapping[str | None, float] | None = None,
    room: int = ROOM,
    least: int = LEAST,
    queues: int = QUEUES,
    id_col: str = "doc_id",
    text_col: str = "text",
    queue_col: str | None = "source",
) -> DataFrame:
    """``id, queue, start, length, ids, doc_tokens, sequence_id, offset`` per piece; ``ids`` are little-endian unsigned 32-bit bytes.

    ``weights`` are the target shares of the sources; without them the sources'
    shares of all tokens are the target, so that every sequence has the mixture
    of the corpus.  A source that is not named has the least weight.
    """
    spark = docs.sparkSession
    coded = tokenised(docs, tokenizer_path, end_id, id_col, text_col, queue_col)
    counts = stored(coded.groupBy("part", "queue").agg(F.sum("n").alias("n")))
    # At most `queues` rows come to the driver, however many sources there are.
    largest = counts.groupBy("queue").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("queue")).limit(queues).collect()
    names = spark.createDataFrame([(r["queue"], i) for i, r in enumerate(largest)], "name string, lane int")
    same = F.col("queue").eqNullSafe(F.col("name"))
    lanes = counts.join(F.broadcast(names), same, "left").select("part", "queue", "n", F.coalesce("lane", F.lit(len(largest))).alias("lane"))
    rest = lanes.where(F.col("lane") == len(largest)).agg(F.sum("n")).first()[0]
    totals = [r["n"] for r in largest] + ([rest] if rest else [])
    if weights is None:
        targets = [float(t) for t in totals]
    else:
        lowest = min((w for w in weights.values() if w > 0), default=1.0)
        targets = [float(weights.get(r["queue"], lowest)) for r in largest] + [lowest] * bool(rest)
    plan = Rounds(totals, targets, room, least)
    earlier = Window.partitionBy("lane").orderBy("part", F.asc_nulls_first("queue")).rowsBetween(Window.unboundedPreceding, -1)
    before = stored(lanes.select(F.col("part").alias("p"), F.col("queue").alias("q"), "lane", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    here = (F.col("part") == F.col("p")) & F.col("queue").eqNullSafe(F.col("q"))
    known = coded.join(before, here).select("id", "queue", "lane", (F.col("before") + F.col("at")).alias("start"), "n", "ids")

    def place(batches):
        for whole in batches:
            row = 0
            sizes = np.cumsum(whole.column(4).to_numpy()) * 4
            while row < whole.num_rows:
                past = sizes[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(sizes, past + _ID_BYTES, "right")))
                yield placed(whole.slice(row, stop - row))
                row = stop

    def placed(batch):
        lane, start, n = (batch.column(i).to_numpy() for i in (2, 3, 4))
        pieces = []
        for queue in np.unique(lane):
            mine = np.flatnonzero(lane == queue)
            row, token, length, at = plan.place(int(queue), start[mine], start[mine] + n[mine])
            pieces.append((mine[row], token - start[mine][row], length, at))
        row, begin, length, at = (np.concatenate(x) for x in zip(*pieces, strict=True))
        ids = batch.column(5).to_pylist()
        cut = [ids[r][4 * b : 4 * (b + m)] for r, b, m in zip(row.tolist(), begin.tolist(), length.tolist(), strict=True)]
        taken = pa.array(row)
        return pa.record_batch(
            [
                batch.column(0).take(taken),
                batch.column(1).take(taken),
                pa.array(begin),
                pa.array(length),
                pa.array(cut, pa.binary()),
                batch.column(4).take(taken),
                pa.array(at // room),
                pa.array(at % room),
            ],
            names=["id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return known.mapInArrow(
        place, f"id {kind}, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def sequences(pieces: DataFrame, pad_id: int = 0, room: int = ROOM) -> DataFrame:
    """``sequence_id, ids, length``: the packed sequences as arrays of ``room`` ids, the last one padded. A sequence bounds its group."""
    listed = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def lay(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4") for parts in batch.column(1).to_pylist()]
            full = [np.pad(x, (0, room - len(x)), constant_values=pad_id).astype(np.int32) for x in ids]
            arrays = [batch.column(0), pa.array(full, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.record_batch(arrays, names=["sequence_id", "ids", "length"])

    return listed.mapInArrow(lay, "sequence_id long, ids array<int>, length long")
