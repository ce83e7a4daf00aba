"""Hard negatives by rotated one-bit codes, interval filtering and exact scores.

A vector is rotated and replaced by the signs of its components.  Stored with
the signs is their alignment, the inner product of the vector with the unit
code vector, and the length of what is left of the vector beside it.  What is
left is coded again, with a rotation of its own, ``layers`` times.

For a query, cut into bit planes, the inner product with a code vector is a sum
of popcounts.  The estimate of a score adds up alignment times code product;
the rest of the vector is orthogonal to the last code vector, so by
Cauchy-Schwarz its share is at most its length times the length of the query
beside that code vector.  With the error of the planes, bounded in the same
way, this gives an interval that holds the score for certain.  Only rows whose
interval reaches into what is asked, and above the lower ends of enough others,
are scored, in whole numbers.

Rows and anchors are packed into blocks, and every block of rows meets every
block of anchors: the stated query set against all rows.  They meet in an
exchange and never by broadcast, so the driver holds neither.  A task works on
one block of each, and returns for an anchor no more rows than are asked for, so
the answers that are merged grow with the blocks and not with the rows.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part.  Ties go to the smaller identifier, null identifiers
last; a null identifier is never an anchor.  Repeated rows are rows of their
own: each is an anchor, and another's positive or negative.  Vectors of unlike
length are never compared.  Components beyond 2**62 after scaling stop the
query.  An anchor without positives, and a positive without negatives, give no
row, as does an empty table.  Columns other than the three named ones are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import stored

LAYERS, PLANES = 4, 8
#: Rows and anchors of a block.
ROW_BLOCK, ANCHOR_BLOCK = 8192, 1024
#: Parts of the rows that meet the anchors independently.
PARTS = 64
#: Blocks of anchors beside a part of the rows; more are cut into groups, each of which meets a copy of the rows.
HELD = 256
#: Anchors whose estimates are made at a time.
_STRIP = 32
_SEED = 2024


@lru_cache(maxsize=8)
def rotation(size: int, layer: int) -> np.ndarray:
    """A random rotation of ``size`` dimensions, the same in every task."""
    draw = np.random.default_rng([_SEED, layer, size]).normal(size=(size, size))
    return np.linalg.qr(draw)[0] if size else draw


def _bits(signs: np.ndarray) -> np.ndarray:
    """Booleans per row as 64-bit words."""
    packed = np.packbits(signs, axis=1)
    width = -(-max(signs.shape[1], 1) // 64) * 8
    out = np.zeros((len(signs), width), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def encode(vectors: np.ndarray, layers: int = LAYERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, layers, words), alignments (rows, layers) and the length of the rest (rows)."""
    rest = vectors.astype(np.float64)
    size = vectors.shape[1]
    codes, aligned = [], []
    for layer in range(layers):
        turned = rest @ rotation(size, layer)
        signs = turned >= 0
        unit = np.where(signs, 1.0, -1.0) / np.sqrt(max(size, 1))
        along = (turned * unit).sum(axis=1)
        rest = (turned - along[:, None] * unit) @ rotation(size, layer).T
        codes.append(_bits(signs))
        aligned.append(along)
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.sqrt((rest * rest).sum(axis=1))


class Planes:
    """Queries as bit planes of every layer's rotation, with the error that the planes leave."""

    def __init__(self, queries: np.ndarray, layers: int = LAYERS, planes: int = PLANES):
        queries = queries.astype(np.float64)
        self.planes, self.size = planes, queries.shape[1]
        self.length = np.sqrt((queries * queries).sum(axis=1))
        self.words, self.low, self.step, self.total, self.error = [], [], [], [], []
        for layer in range(layers):
            turned = queries @ rotation(self.size, layer)
            low = turned.min(axis=1, initial=0.0)
            step = np.maximum((turned.max(axis=1, initial=0.0) - low) / ((1 << planes) - 1), 1e-300)
            level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
            left = turned - (low[:, None] + step[:, None] * level)
            self.words.append(np.stack([_bits((level >> p & 1).astype(bool)) for p in range(planes)], axis=1))
            self.low.append(low)
            self.step.append(step)
            self.total.append(low * self.size + step * level.sum(axis=1))
            self.error.append(np.sqrt((left * left).sum(axis=1)))

    def counted(self, layer: int, some: slice | np.ndarray, code: np.ndarray) -> np.ndarray:
        """Sums of the planes of some queries where the codes of a layer have a one: popcounts, from the highest plane down."""
        words, most = self.words[layer][some], self.size << self.planes
        summed = np.zeros((len(words), len(code)), dtype=np.uint16 if most < 1 << 16 else np.int64)
        both, hits = np.empty(summed.shape, dtype=np.uint64), np.empty(summed.shape, dtype=np.uint8)
        for p in reversed(range(self.planes)):
            summed <<= 1
            for w in range(code.shape[1]):
                np.bitwise_and(words[:, p, w][:, None], code[None, :, w], out=both)
                summed += np.bitwise_count(both, out=hits)
        return summed

    def interval(self, some: slice | np.ndarray, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of some queries (rows of the result) with coded vectors."""
        root, sized = np.sqrt(max(self.size, 1)), np.abs(aligned)
        estimate = np.zeros((len(self.length[some]), len(rest)))
        for layer in range(len(self.words)):
            code = np.ascontiguousarray(codes[:, layer])
            ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
            product = self.counted(layer, some, code) * (2 / root * self.step[layer][some])[:, None]
            product += np.stack([2 / root * self.low[layer][some], -self.total[layer][some] / root], axis=1) @ np.stack([ones, np.ones(len(ones))])
            if layer == len(self.words) - 1:
                along = np.maximum(np.abs(product) - self.error[-1][some][:, None], 0)
            product *= aligned[:, layer]
            estimate += product
        beside = np.sqrt(np.maximum((self.length[some] ** 2)[:, None] - along**2, 0))
        # The last column and the constant cover the rounding of all sums above.
        slack = np.stack([*(error[some] for error in self.error), 1e-9 * self.length[some]], axis=1)
        width = slack @ np.concatenate([sized.T, (rest + sized.sum(axis=1))[None]])
        beside *= rest
        width += beside
        width += 1e-6
        return estimate - width, estimate + width


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where no sum can lose a digit."""
    if len(vectors) == 0:
        return np.zeros(0, dtype=np.int64)
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(len(query), 1)
    if bound < 1 << 53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    found = vectors.astype(object) @ query.astype(object)
    return np.array([int(x) for x in found], dtype=np.int64)


_KINDS = {2: np.int16, 4: np.int32, 8: np.int64}


def _narrow(vectors: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if np.abs(vectors).max(initial=0) <= np.iinfo(kind).max:
            return vectors.astype(kind)
    return vectors


def _ints(values: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * scale)
    if np.abs(scaled).max(initial=0) > float(1 << 62):
        raise OverflowError("a scaled component exceeds 2**62")
    return scaled.astype(np.int64)


#: The bits of a row block's number that count the blocks of its task.
_NUMBER = 24
_PACKED = "size int, block long, uid binary, id binary, named binary, label binary, asks binary, width int, vectors binary, codes binary, aligned binary, rest binary"
_ANCHOR = "uid long, id long, label long, size int, vector binary"


def pack_rows(rows: DataFrame, scale: int, block: int, layers: int = LAYERS) -> DataFrame:
    """Blocks of at most ``block`` rows of ``id, label, vector, asks`` with their codes; one row each."""

    def blocks(batches):
        part, count = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {}

        def packed(size, rows):
            nonlocal count
            ids = np.array([r[0] or 0 for r in rows], dtype=np.int64)
            whole = _ints(np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), size), scale)
            codes, aligned, rest = encode(whole, layers)
            small = _narrow(whole)
            number = (part << _NUMBER) + count
            count += 1
            columns = [
                (np.arange(len(rows), dtype=np.int64) + (number << 13)),
                ids,
                np.array([r[0] is not None for r in rows]),
                np.array([r[1] for r in rows], dtype=np.int64),
                np.array([bool(r[3]) for r in rows]),
            ]
            return pa.record_batch(
                [
                    pa.array([size], pa.int32()),
                    pa.array([number], pa.int64()),
                    *[pa.array([c.tobytes()], pa.binary()) for c in columns],
                    pa.array([small.itemsize], pa.int32()),
                    *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (small, codes, aligned, rest)],
                ],
                names=["size", "block", "uid", "id", "named", "label", "asks", "width", "vectors", "codes", "aligned", "rest"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vector = row[2]
                some = waiting.setdefault(len(vector), [])
                some.append(row)
                if len(some) == block:
                    yield packed(len(vector), waiting.pop(len(vector)))
        for size, some in waiting.items():
            yield packed(size, some)

    if block > 1 << 13:
        raise ValueError("a block holds at most 8192 rows")
    return rows.select("id", "label", "vector", "asks").mapInArrow(blocks, _PACKED)


class _Block:
    """A packed block of rows in memory."""

    def __init__(self, row: dict, layers: int):
        self.uid, self.id, self.label = (np.frombuffer(row[c], dtype=np.int64) for c in ("uid", "id", "label"))
        self.named, self.asks = (np.frombuffer(row[c], dtype=bool) for c in ("named", "asks"))
        n, size = len(self.uid), row["size"]
        self.vectors = np.frombuffer(row["vectors"], dtype=_KINDS[row["width"]]).reshape(n, size)
        self.codes = np.frombuffer(row["codes"], dtype=np.uint64).reshape(n, layers, -1)
        self.aligned = np.frombuffer(row["aligned"], dtype=np.float64).reshape(n, layers)
        self.rest = np.frombuffer(row["rest"], dtype=np.float64)

    def first(self, at: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
        """Of the rows ``at`` the first ``count`` by score, ties by identifier, null identifiers last."""
        return np.lexsort((self.uid[at], self.id[at], ~self.named[at], -scores))[:count]


def _asking(rows: DataFrame, layers: int) -> DataFrame:
    """The anchors among the packed rows, one row each."""

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, layers)
                at = np.flatnonzero(block.asks)
                vectors = [v.tobytes() for v in block.vectors[at].astype(np.int64)]
                columns = [pa.array(block.uid[at]), pa.array(block.id[at]), pa.array(block.label[at])]
                columns += [pa.array([row["size"]] * len(at), pa.int32()), pa.array(vectors, pa.binary())]
                yield pa.record_batch(columns, names=["uid", "id", "label", "size", "vector"])

    return rows.mapInArrow(unpack, _ANCHOR)


def _anchor_blocks(anchors: DataFrame, block: int, count: int) -> DataFrame:
    """Anchors ``uid, id, label, size, vector, asked`` in blocks of at most ``block``; ``asked`` has at most ``count`` scores."""

    def blocks(batches):
        part = TaskContext.get().partitionId()
        waiting: dict[int, list] = {}

        def packed(size, rows):
            scores = np.zeros((len(rows), count), dtype=np.int64)
            for i, row in enumerate(rows):
                scores[i, : len(row["asked"] or ())] = [a["score"] for a in sorted(row["asked"] or (), key=lambda a: a["rank"])]
            columns = [np.array([row[c] for row in rows], dtype=np.int64) for c in ("uid", "id", "label")]
            columns.append(np.array([len(row["asked"] or ()) for row in rows], dtype=np.int64))
            small = _narrow(np.frombuffer(b"".join(row["vector"] for row in rows), dtype=np.int64))
            numbers = [size, part, small.itemsize]
            values = [*[c.tobytes() for c in columns], scores.tobytes(), small.tobytes()]
            names = ["a_size", "a_part", "a_width", "a_uid", "a_id", "a_label", "a_asked", "a_scores", "a_vectors"]
            return pa.record_batch([*[pa.array([n], pa.int32()) for n in numbers], *[pa.array([v], pa.binary()) for v in values]], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                some = waiting.setdefault(row["size"], [])
                some.append(row)
                if len(some) == block:
                    yield packed(row["size"], waiting.pop(row["size"]))
        for size, some in waiting.items():
            yield packed(size, some)

    kept = anchors.select("uid", "id", "label", "size", "vector", "asked")
    return kept.mapInArrow(blocks, "a_size int, a_part int, a_width int, a_uid binary, a_id binary, a_label binary, a_asked binary, a_scores binary, a_vectors binary")


class _Anchors:
    """A packed block of anchors in memory."""

    def __init__(self, row: dict, layers: int, planes: int):
        self.uid, self.id, self.label, self.asked = (np.frombuffer(row[c], dtype=np.int64) for c in ("a_uid", "a_id", "a_label", "a_asked"))
        n = len(self.uid)
        self.scores = np.frombuffer(row["a_scores"], dtype=np.int64).reshape(n, -1)
        self.vectors = np.frombuffer(row["a_vectors"], dtype=_KINDS[row["a_width"]]).astype(np.int64).reshape(n, row["a_size"])
        self.planes = Planes(self.vectors, layers, planes)


def _meet(rows: DataFrame, anchors: DataFrame, parts: int, groups: int) -> DataFrame:
    """Each block of rows beside each block of anchors of the same length of vectors.

    Each place has a task of its own and holds one of ``parts`` of the rows and
    one of ``groups`` of the anchors.  The copies of the anchors go through the
    exchange: a broadcast would gather all of them in the driver, and the sizes
    by which Spark decides on one are those before they are copied.
    """
    # The blocks of a task go to parts one after another; tasks begin well apart.
    begin = F.floor(F.shiftright("block", _NUMBER) * (parts * 0.618034)).cast("long")
    part = F.pmod(begin + F.col("block").bitwiseAND((1 << _NUMBER) - 1), F.lit(parts))
    first = (part * groups).cast("int")
    left = rows.withColumn("place", F.explode(F.sequence(first, first + (groups - 1))))
    right = anchors.withColumn("a_place", F.explode(F.sequence(F.pmod("a_part", F.lit(groups)), F.lit(parts * groups - 1), F.lit(groups))))
    left, right = left.repartitionById(parts * groups, "place"), right.repartitionById(parts * groups, "a_place")
    return left.join(right.hint("merge"), (F.col("place") == F.col("a_place")) & (F.col("size") == F.col("a_size"))).drop("place", "a_place")


def _pairs(batches, layers: int, planes: int, alike: bool) -> Iterator[tuple]:
    """The blocks that meet, and for each anchor its number, the rows to score and the bounds of its scores with them.

    The rows are those of the anchor's label where ``alike``, otherwise all.
    """
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            block, anchors = _Block(row, layers), _Anchors(row, layers, planes)
            every = np.arange(len(block.uid)), np.arange(len(anchors.uid))
            kinds = [(every[0][block.label == x], every[1][anchors.label == x]) for x in np.unique(anchors.label)] if alike else [every]
            for rows, asking in kinds:
                codes = block.codes[rows], block.aligned[rows], block.rest[rows]
                for begin in range(0, len(asking) if len(rows) else 0, _STRIP):
                    some = asking[begin : begin + _STRIP]
                    lower, upper = anchors.planes.interval(some, *codes)
                    for i in range(len(some)):
                        yield block, anchors, some[i], rows, lower[i], upper[i]


def _at_least(lower: np.ndarray, count: int) -> float:
    """A score that ``count`` of the rows reach for certain."""
    if len(lower) < count:
        return -np.inf
    return np.partition(lower, len(lower) - count)[len(lower) - count]


class _Found:
    """Answers of a task, given out a few thousand at a time."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.size = names, [], 0

    def add(self, anchor: int, anchor_id: int, turn: int, block: _Block, at: np.ndarray, scores: np.ndarray) -> None:
        n = len(at)
        self.parts.append(([anchor] * n, [anchor_id] * n, [turn] * n, block.uid[at].tolist(), [i if k else None for i, k in zip(block.id[at].tolist(), block.named[at])], scores.tolist()))
        self.size += n

    def batch(self) -> pa.RecordBatch:
        columns = [sum((list(p[i]) for p in self.parts), []) for i in range(6)]
        self.parts, self.size = [], 0
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=self.names)


_FOUND = "a_uid long, a_id long, turn int, uid long, id long, score long"


def _finder(find, layers: int, planes: int, alike: bool):
    def run(batches):
        found = _Found([c.split()[0] for c in _FOUND.split(", ")])
        for block, anchors, i, rows, lower, upper in _pairs(batches, layers, planes, alike):
            find(found, block, anchors, i, rows, lower, upper)
            if found.size > 20_000:
                yield found.batch()
        if found.size:
            yield found.batch()

    return run


def _positives(count: int):
    """The first ``count`` rows of the anchor's label in a block."""

    def find(found, block, anchors, i, rows, lower, upper):
        others = block.uid[rows] != anchors.uid[i]
        mine = rows[others & (upper >= _at_least(lower[others], count))]
        scores = exact(block.vectors[mine], anchors.vectors[i])
        best = block.first(mine, scores, count)
        found.add(anchors.uid[i], anchors.id[i], 0, block, mine[best], scores[best])

    return find


def _negatives(count: int, low: int, high: int):
    """For each positive of the anchor the first ``count`` rows of other labels in a block whose score is in its range."""

    def find(found, block, anchors, i, rows, lower, upper):
        ranges = [(-(-low * score // 100), high * score // 100) for score in map(int, anchors.scores[i][: anchors.asked[i]])]
        if not ranges:
            return
        near = (upper >= min(r[0] for r in ranges)) & (lower <= max(r[1] for r in ranges))
        near &= block.label[rows] != anchors.label[i]
        near = np.flatnonzero(near)
        rows, lower, upper = rows[near], lower[near], upper[near]
        wanted = []
        for least, most in ranges:
            inside = np.flatnonzero((upper >= least) & (lower <= most))
            lows, tops = lower[inside], upper[inside]
            wanted.append(inside[tops >= _at_least(lows[(lows >= least) & (tops <= most)], count)])
        asked, scores = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=np.int64)
        asked[np.concatenate(wanted)] = True
        scores[asked] = exact(block.vectors[rows[asked]], anchors.vectors[i])
        for turn, ((least, most), some) in enumerate(zip(ranges, wanted, strict=True), 1):
            some = some[(scores[some] >= least) & (scores[some] <= most)]
            best = some[block.first(rows[some], scores[some], count)]
            found.add(anchors.uid[i], anchors.id[i], turn, block, rows[best], scores[best])

    return find


def _best(found: DataFrame, group: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    table: DataFrame,
    anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    layers: int = LAYERS,
    planes: int = PLANES,
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
    parts: int = PARTS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its first other rows of the same label; of each
    the first rows of other labels with ``low * positive <= 100 * negative <=
    high * positive`` are returned.  ``anchor`` and ``label`` are expressions on
    the table; a component x becomes floor(scale * x).
    """
    vector = F.col(vector_col)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = table.where(F.col(label_col).isNotNull() & vector.isNotNull() & sound)
    named = usable.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(label_col) if label is None else label).cast("long").alias("label"),
        vector.alias("vector"),
        (anchor & F.col(id_col).isNotNull()).alias("asks"),
    )
    rows = stored(pack_rows(named, scale, row_block, layers))
    anchors = stored(_asking(rows, layers))
    blocks = max(1, -(-anchors.count() // anchor_block))
    used, groups = max(1, min(parts, rows.count())), -(-blocks // HELD)

    def found(asking: DataFrame, find, alike: bool) -> DataFrame:
        packed = stored(_anchor_blocks(asking.repartition(blocks, "uid"), anchor_block, positives))
        return _meet(rows, packed, used, groups).mapInArrow(_finder(find, layers, planes, alike), _FOUND)

    nothing = F.lit(None).cast("array<struct<rank:int,score:bigint>>").alias("asked")
    first = stored(_best(found(anchors.select("*", nothing), _positives(positives), True), ["a_uid"], positives))
    lists = first.groupBy("a_uid").agg(F.collect_list(F.struct("rank", "score")).alias("asked"))
    asking = anchors.join(lists.hint("merge"), F.col("uid") == F.col("a_uid"))
    last = _best(found(asking, _negatives(negatives, low, high), False).drop("a_id"), ["a_uid", "turn"], negatives)
    one = first.select("a_uid", F.col("rank").alias("turn"), F.col("a_id").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return last.join(one.hint("merge"), ["a_uid", "turn"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
