"""Benchmark decontamination by edit distance.

A document is contaminated by an item when some part of it is within the
item's edit budget: a tenth of the item's bytes, and less than the number of
its eight-byte pieces.  Texts are compared with A-Z folded and white space
collapsed.

Windows are embedded by the CGK random walk, which turns edit distance into
Hamming distance, and hashed by sampled coordinates.  An item is cut into equal
parts of at most ``PART`` bytes, because two walks drift apart the longer they
are; one of the parts has at most its share of the edits.  A window that agrees
with a part in any of the repetitions has the whole item verified by the exact
edit distance.  Only windows that can be within the budget are embedded, one at
each diagonal of unchanged pieces: each edit spoils at most one of an item's
disjoint eight-byte pieces, so the rest must occur unchanged near one diagonal.
That bound is exact; the sampling is the only step with a chance of missing,
and its repetitions are chosen for the recall below at the full budget.

Items are held by every task. Their bytes are counted first, and more than
``SLICE_BYTES`` of them are taken in several passes over the documents.

Defined cases: null and empty items and texts match nothing; an item of fewer
than 16 folded bytes must occur exactly.  Repeated rows get equal answers and
equal items are each reported.  Empty tables give an empty result.  Columns not
named are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 8
SLICE_BYTES = 8 << 20
#: Most bytes of an item that are embedded as one.
PART = 200
#: Coordinates per repetition, and repetitions. A part at its full budget agrees in one repetition with
#: probability 0.07 to 0.19 (measured on edits of 80 to 400 bytes), so 64 repetitions miss at most 1 in 80.
SAMPLED, REPETITIONS = 4, 64
_WALK = 20070611
_CHUNK = 4 << 20
_SPACE = re.compile(rb"[ \t-\r]{2,}|[\t-\r]")  # single spaces stay as they are
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def normal(text: str | None) -> bytes:
    return _SPACE.sub(b" ", text.encode().lower()).strip(b" ") if text else b""


def budget(size: int) -> int:
    """Edits that an item of this many bytes allows."""
    return 0 if size < 2 * PIECE else min(size // 10, size // PIECE - 1)


def least_edits(item: bytes, text: bytes) -> int:
    """The edit distance between the item and the part of the text nearest to it (bit-parallel columns)."""
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, score = full, 0, len(item)
    best = score
    for c in text:
        same = masks.get(c, 0)
        flat = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(flat | up), up & flat
        score += 1 if rise & top else -1 if fall & top else 0
        best = min(best, score)
        rise, fall = rise << 1, fall << 1
        same |= down
        up, down = (fall | ~(same | rise)) & full, rise & same & full
    return best


class Walks:
    """The random walks of all repetitions, from a fixed seed."""

    def __init__(self, longest: int = PART):
        draw = np.random.default_rng(_WALK)
        self.places = draw.random((REPETITIONS, SAMPLED))
        self.steps = 2 * longest + 1
        self.bits = draw.integers(0, 2, size=(REPETITIONS, self.steps, 256), dtype=np.uint8)

    def keys(self, repetitions: range, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sampled coordinates of the rows' embeddings as numbers, one line per repetition. Rows are padded with zeros."""
        each = np.tile(np.arange(len(rows)), len(repetitions))
        r = np.repeat(np.array(repetitions), len(rows))
        wanted = (self.places[r] * (2 * sizes[each])[:, None]).astype(np.int64)
        order = np.argsort(wanted, axis=None, kind="stable")
        due = np.searchsorted(wanted.ravel()[order], np.arange(int(wanted.max()) + 2))
        at = np.zeros(len(each), dtype=np.int64)
        found = np.zeros(wanted.size, dtype=np.uint8)
        for step in range(int(wanted.max()) + 1):
            seen = rows[each, at]
            hit = order[due[step] : due[step + 1]]
            found[hit] = seen[hit // SAMPLED]
            at += self.bits[r, step, seen]
            np.minimum(at, rows.shape[1] - 1, out=at)
        return found.view(np.uint32).reshape(len(repetitions), len(rows))


#: Copies meet in the first repetition; the others are walked together.
_ROUNDS = (range(0, 1), range(1, 8), range(8, REPETITIONS))


def _rows(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in windows], dtype=np.int64)
    rows = np.zeros((len(windows), int(sizes.max()) + 1), dtype=np.uint8)
    for i, w in enumerate(windows):
        rows[i, : len(w)] = np.frombuffer(w, dtype=np.uint8)
    return rows, sizes


class Items:
    """The items of one pass: their pieces for the search, their embeddings for the check."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.tiny = [i for i, t in enumerate(texts) if 0 < len(t) < 2 * PIECE]
        long = [i for i, t in enumerate(texts) if len(t) >= 2 * PIECE]
        self.budget = np.array([budget(len(t)) for t in texts], dtype=np.int64)
        self.need = np.array([max(1, len(t) // PIECE - budget(len(t))) for t in texts], dtype=np.int64)
        pieces = [(t, i, o) for i in long for o in range(0, len(texts[i]) - PIECE + 1, PIECE) for t in (texts[i][o : o + PIECE],)]
        value = np.frombuffer(b"".join(p[0] for p in pieces), dtype="<u8")
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.item = np.array([p[1] for p in pieces], dtype=np.int64)[order]
        self.offset = np.array([p[2] for p in pieces], dtype=np.int64)[order]
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[(self.value * _SPREAD) >> np.uint64(64 - _BITS)] = True
        # The parts of all items, those of item i from first[i] on.
        count = [-(-len(t) // PART) if len(t) >= 2 * PIECE else 0 for t in texts]
        self.first = np.concatenate(([0], np.cumsum(count))).astype(np.int64)
        self.bounds = [np.arange(n + 1) * len(t) // max(n, 1) for t, n in zip(texts, count, strict=True)]
        self.keys = None
        if long:
            walks = Walks()
            parts = [texts[i][a:b] for i in long for a, b in zip(self.bounds[i], self.bounds[i][1:])]
            self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
            chunks = [_rows(parts[at : at + 4096]) for at in range(0, len(parts), 4096)]
            self.keys = np.concatenate([walks.keys(range(REPETITIONS), *c) for c in chunks], axis=1)

    def seeds(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the data, item and offset of every piece that occurs."""
        places, values = [], []
        for shift in range(PIECE):
            n = (len(data) - shift) // PIECE
            if n <= 0:
                break
            v = np.frombuffer(data, dtype="<u8", offset=shift, count=n)
            hit = np.flatnonzero(self.filter[(v * _SPREAD) >> np.uint64(64 - _BITS)])
            places.append(hit * PIECE + shift)
            values.append(v[hit])
        if not places or not len(self.value):
            return (np.zeros(0, dtype=np.int64),) * 3
        place, value = np.concatenate(places), np.concatenate(values)
        lo, hi = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        n = hi - lo
        at = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.repeat(place, n), self.item[at], self.offset[at]


def _search(items: Items, walks: Walks | None, texts: list[bytes]) -> dict[tuple[int, int], int]:
    """(text, item) -> least edits, of texts joined into one piece of data."""
    found: dict[tuple[int, int], int] = {}
    for k in items.tiny:
        for d, t in enumerate(texts):
            if items.texts[k] in t:
                found[d, k] = 0
    data = b"\x00".join(texts)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    place, item, offset = items.seeds(data)
    if not len(place):
        return found
    doc = np.searchsorted(begin, place, "right") - 1
    start = place - offset
    order = np.lexsort((offset, start, item, doc))
    doc, item, offset, start = doc[order], item[order], offset[order], start[order]
    # The item's surviving pieces lie on diagonals that differ by twice the budget at most.
    last = np.arange(len(doc)) + items.need[item] - 1
    inside = last < len(doc)
    last = np.minimum(last, len(doc) - 1)
    good = inside & (doc[last] == doc) & (item[last] == item) & (start[last] - start <= 2 * items.budget[item])
    group = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True])))
    windows: list[bytes] = []
    of: list[tuple[int, int, int]] = []
    part_of: list[int] = []
    candidates = np.flatnonzero(good)
    for g in np.unique(np.searchsorted(group, candidates, "right")) - 1:
        a, stop = group[g], group[g + 1]
        d, k = int(doc[a]), int(item[a])
        text, wide, needed = items.texts[k], 2 * int(items.budget[k]), int(items.need[k])
        first, end = int(begin[d]), int(begin[d + 1]) - 1
        live = np.zeros(stop - a, dtype=bool)
        for j in candidates[slice(*np.searchsorted(candidates, (a, stop)))]:
            run = slice(j, j + int(np.searchsorted(start[j:stop], start[j] + wide, "right")))
            # A piece that occurs several times there is one piece that survived.
            if len(np.unique(offset[run])) < needed:
                continue
            s = int(start[j])
            if s >= first and data.startswith(text, s, end):
                # Equal strings have equal embeddings and no edits; nothing nearer can follow.
                found[d, k] = 0
                break
            live[run.start - a : run.stop - a] = True
        if found.get((d, k)) == 0 or not live.any():
            continue
        seeds = a + np.flatnonzero(live)
        bounds = items.bounds[k]
        parts = np.searchsorted(bounds, offset[seeds], "right") - 1
        for s, p in np.unique(np.stack([start[seeds], parts], axis=1), axis=0).tolist():
            window = data[max(first, s + int(bounds[p])) : max(first, min(s + int(bounds[p + 1]), end))]
            if window:
                windows.append(window)
                of.append((d, k, s))
                part_of.append(int(items.first[k]) + p)
    close = np.zeros(len(windows), dtype=bool)
    which = np.array(part_of, dtype=np.int64)
    agreed: set[tuple[int, int, int]] = set()
    for repetitions in _ROUNDS:
        # One part that agrees is enough for its diagonal.
        rest = np.array([i for i, w in enumerate(of) if w not in agreed], dtype=np.int64)
        for some in np.array_split(rest, -(-len(rest) // 512)) if len(rest) else ():
            rows, _ = _rows([windows[i] for i in some])
            mine = walks.keys(repetitions, rows, items.sizes[which[some]])
            close[some] = (mine == items.keys[repetitions.start : repetitions.stop, which[some]]).any(axis=0)
        agreed.update(of[i] for i in np.flatnonzero(close))
    # Diagonals whose stretches of text overlap are verified as one stretch.
    stretches: list[list[int]] = []
    for d, k, s in sorted(agreed):
        size, allowed = len(items.texts[k]), int(items.budget[k])
        low, high = max(int(begin[d]), s - 2 * allowed), min(s + size + 4 * allowed, int(begin[d + 1]) - 1)
        if stretches and stretches[-1][:2] == [d, k] and low < stretches[-1][3]:
            stretches[-1][3] = max(high, stretches[-1][3])
        else:
            stretches.append([d, k, low, high])
    for d, k, low, high in stretches:
        edits = least_edits(items.texts[k], data[low:high])
        if edits <= items.budget[k]:
            found[d, k] = min(edits, found.get((d, k), edits))
    return found


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``keep, item_id, edits``: one row per document row and item within the item's edit budget."""
    known = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("octet_length(text) > 0")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-2 * size // slice_bytes)) if size > slice_bytes else 1
    return reduce(
        DataFrame.union,
        [
            _pass(docs, known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i), keep, text_col)
            for i in range(slices)
        ],
    )


def _pass(docs: DataFrame, known: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    rows = known.orderBy("item_id", "text").collect()
    ids = [r["item_id"] for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast(Items([normal(r["text"]) for r in rows]))
    kind = known.schema["item_id"].dataType
    fields = [(c, docs.schema[c].dataType.simpleString()) for c in keep]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*fields, ("item_id", kind.simpleString()), ("edits", "int")])

    def search(batches):
        held = shared.value
        walks = Walks() if held.keys is not None else None
        for batch in batches:
            texts = [normal(t) for t in batch.column(0).to_pylist()]
            at = 0
            hits: list[tuple[int, int, int]] = []
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _CHUNK):
                    size += len(texts[stop])
                    stop += 1
                hits += [(at + d, k, e) for (d, k), e in _search(held, walks, texts[at:stop]).items()]
                at = stop
            which = pa.array([h[0] for h in hits], pa.int64())
            kept = [batch.column(i).take(which) for i in range(1, batch.num_columns)]
            found = pa.array([ids[h[1]] for h in hits], _arrow(kind))
            yield pa.record_batch([*kept, found, pa.array([h[2] for h in hits], pa.int32())], names=[*keep, "item_id", "edits"])

    return docs.select(F.col(text_col).alias("__text"), *keep).mapInArrow(search, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
