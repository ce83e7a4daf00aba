"""Removal of long repeated strings by merging Burrows-Wheeler columns of aligned suffixes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts
anywhere else.  Sorting the suffixes of a whole corpus for that is neither
possible in one task nor needed:

1. Every window of LENGTH bytes picks an anchor, the least hashed ``GRAM``-byte
   string inside it, the leftmost of equals.  Equal windows pick the same
   anchor at the same place, so only windows of one anchor string need to be
   compared.  The windows of one anchor are contiguous; the bytes that they
   cover are its segment.  Each partition of documents is a shard that sends
   digests of its segments only.
2. Segments whose anchor string is unique hold no repeat, and segments that
   occur twice are repeats throughout.  What is left are segments at the ends
   of repeats; one of each kind is fetched.
3. The shards' segments of one anchor string are aligned, so their suffixes
   form the columns of a (positional) Burrows-Wheeler transform.  The interleave
   of all shards is refined column by column: each step distributes the current
   order stably by the symbol before it, and carries the common prefix of
   neighbours along (one more than the least between them).  No suffix is
   compared or sorted again.  Where the common prefix with a neighbour reaches
   LENGTH, the window is repeated.

An anchor string with more distinct segments than ``GROUP_SEGMENTS`` is not
merged in one task: its windows are counted by digest, with partial counts.

Defined cases: matches never cross rows.  A null text is empty, and texts of
fewer than LENGTH bytes lose nothing.  Repeated rows repeat each other.  A null
identifier is a value like any other.  An empty table gives an empty result.
Columns not named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.words import mix
from tallymark.session import stored

LENGTH = 200
GRAM = 32
GROUP_SEGMENTS = 100_000
#: Segment bytes that one merging task holds, about.
MERGE_BYTES = 12 << 20
_PLACES = 20
_CHUNK = (1 << _PLACES) - LENGTH
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _grams(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes at every place."""
    count = len(data) - 7
    words = np.empty(count, dtype=np.uint64)
    for shift in range(8):
        n = len(range(shift, count, 8))
        words[shift::8] = np.frombuffer(data, dtype="<u8", offset=shift, count=n)
    places = len(data) - GRAM + 1
    value = np.zeros(places, dtype=np.uint64)
    for i, factor in enumerate(_FACTORS):
        value += words[8 * i : 8 * i + places] * np.uint64(factor)
    return mix(value)


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of the data, and the hash of every place's gram."""
    grams = _grams(data)
    low = np.uint64((1 << _PLACES) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return (least & low).astype(np.int64), grams


def segments_of(texts: list[bytes], length: int):
    """Per segment: text, first window, windows, bytes from the first window to the anchor, anchor hash, segment digest."""
    out: list[list] = [[], [], [], [], [], []]
    chunk: list[tuple[int, int, bytes]] = []  # text, place of the piece in it, piece
    size = 0

    def flush():
        data = b"".join(p for _, _, p in chunk)
        anchor, grams = anchors(data, length)
        begin = np.cumsum([0] + [len(p) for _, _, p in chunk])
        piece = np.repeat(np.arange(len(chunk)), np.diff(begin))[: len(anchor)]
        starts = np.arange(len(anchor))
        inside = starts + length <= begin[piece + 1]
        starts, anchor, piece = starts[inside], anchor[inside], piece[inside]
        edge = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))))
        windows = np.diff(np.append(edge, len(starts)))
        first = starts[edge]
        view = memoryview(data)
        digest = xxhash.xxh3_64_intdigest
        of = piece[edge]
        out[0].append(np.array([c[0] for c in chunk], dtype=np.int64)[of])
        out[1].append(first - begin[of] + np.array([c[1] for c in chunk], dtype=np.int64)[of])
        out[2].append(windows)
        out[3].append(anchor[edge] - first)
        out[4].append(grams[anchor[edge]])
        ends = first + windows + (length - 1)
        out[5].append(np.fromiter((digest(view[s:e]) for s, e in zip(first.tolist(), ends.tolist(), strict=True)), np.uint64, len(first)))

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, _CHUNK):
            part = text[at : at + _CHUNK + length - 1]
            if chunk and size + len(part) > _CHUNK:
                flush()
                chunk, size = [], 0
            chunk.append((i, at, part))
            size += len(part)
    if chunk:
        flush()
    return [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out]


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi], both included, for each pair (lo <= hi)."""
    size = hi - lo + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=values.dtype)
    for k in range(int(level.max(initial=-1)) + 1):
        if k:  # values[i] is the least of 1 << k entries from i
            values = np.minimum(values[: -(1 << (k - 1))], values[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(values[lo[at]], values[hi[at] - (1 << k) + 1])
    return out


def repeated_windows(group: np.ndarray, left: np.ndarray, windows: np.ndarray, texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows also occur in another segment of its group.

    Column 0 is the leftmost place that any segment has; anchors share a column.
    """
    n = len(texts)
    reach = int(left.max())
    start = reach - left
    end = start + np.array([len(t) for t in texts], dtype=np.int64)
    columns = int(end.max())
    symbols = np.full((columns, n), 256, dtype=np.int64)
    for i, t in enumerate(texts):
        symbols[start[i] : end[i], i] = np.frombuffer(t, dtype=np.uint8)
    order = np.argsort(group, kind="stable")
    block = np.unique(group[order], return_inverse=True)[1] * 512
    common = np.zeros(n, dtype=np.int32)  # of each entry with the one before it
    hits = np.zeros((columns, n), dtype=bool)
    for column in range(columns - 1, -1, -1):
        symbol = symbols[column, order]
        key = block + symbol
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        alike = np.flatnonzero((key[1:] == key[:-1]) & ((key[1:] & 511) < 256)) + 1
        new = np.zeros(n, dtype=np.int32)
        new[alike] = 1 + _least_between(common, moved[alike - 1] + 1, moved[alike])
        order, common = order[moved], new
        far = np.flatnonzero(common >= length)
        if len(far):
            hits[column, order[far]] = True
            hits[column, order[far - 1]] = True
    return [hits[start[i] : start[i] + windows[i], i] for i in range(n)]


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, group_segments: int = GROUP_SEGMENTS, merge_bytes: int = MERGE_BYTES
) -> DataFrame:
    """``id, version, from, to``: bytes covered by repeated strings (``to`` excluded), unmerged. ``docs`` has ``id, version, text``."""
    if length < GRAM:
        raise ValueError(f"strings of fewer than {GRAM} bytes are not supported")
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            of, first, windows, left, gram, seg = segments_of(texts, length)
            at = pa.array(of.astype(np.int64))
            yield pa.record_batch(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(first.astype(np.int64)),
                    pa.array(windows.astype(np.int32)),
                    pa.array(left.astype(np.int32)),
                    pa.array(gram.astype(np.uint64).view(np.int64)),
                    pa.array(seg.astype(np.uint64).view(np.int64)),
                ],
                names=["id", "version", "first", "windows", "left", "gram", "seg"],
            )

    form = f"id {kind}, version long, first long, windows int, left int, gram long, seg long"
    every = stored(docs.select("id", "version", "text").mapInArrow(cut, form))
    # Stored, so that the join below is one of two plain exchanges, whose hot strings Spark can split.
    common = stored(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    shared = stored(every.join(common, "gram", "left_semi"))
    # One of each kind of segment; any will do, for their bytes are equal.
    kinds = stored(
        shared.groupBy("gram", "seg").agg(
            F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("id", "version", "first", "windows", "left"))
        )
    )
    groups = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    wanted = kinds.join(groups.select("gram", (F.col("kinds") > group_segments).alias("heavy")), "gram")
    per_doc = (
        wanted.groupBy("id", "version")
        .agg(F.collect_list(F.struct("gram", "seg", "n", "first", "windows", "left", "heavy")).alias("cuts"))
        .select(F.col("id").alias("w_id"), F.col("version").alias("w_version"), "cuts")
    )
    fetched = docs.join(per_doc, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("version") == F.col("w_version"))).select("text", "cuts")

    def fetch(batches):
        for batch in batches:
            rows = []
            for text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                rows += [
                    (c["gram"], c["seg"], c["n"], c["windows"], c["left"], c["heavy"], data[c["first"] : c["first"] + c["windows"] + length - 1])
                    for c in cuts
                ]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            names = ["gram", "seg", "n", "windows", "left", "heavy", "bytes"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    segments = fetched.mapInArrow(fetch, "gram long, seg long, n long, windows int, left int, heavy boolean, bytes binary")
    tasks = max(1, -(-wanted.count() * (length + 100) // merge_bytes))

    def merge(key, block):
        seg, n = block.column("seg").to_numpy(), block.column("n").to_numpy()
        flags = repeated_windows(
            block.column("gram").to_numpy(),
            block.column("left").to_numpy().astype(np.int64),
            block.column("windows").to_numpy(),
            block.column("bytes").to_pylist(),
            length,
        )
        rows = [(g, s, *_ranges(f)) for g, s, m, f in zip(block.column("gram").to_numpy(), seg, n, flags, strict=True) if m == 1 and f.any()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["gram", "seg", "starts", "ends"])

    found = "gram long, seg long, starts array<int>, ends array<int>"
    # A repeated row may be fetched twice; one copy of a segment is enough.
    light = segments.where("not heavy").withColumn("task", F.pmod(F.xxhash64("gram"), F.lit(tasks)))
    merged = light.dropDuplicates(["task", "gram", "seg"]).groupBy("task").applyInArrow(merge, found)
    whole = kinds.where("n > 1").select(
        "gram", "seg", F.array(F.lit(0)).alias("starts"), F.array(F.col("windows") - 1).alias("ends")
    )
    answers = whole.union(merged)
    if not groups.where(F.col("kinds") > group_segments).isEmpty():
        answers = answers.union(_counted_windows(segments.where("heavy"), length, found))
    spans = shared.join(answers, ["gram", "seg"]).select(
        "id", "version", "first", F.explode(F.arrays_zip("starts", "ends")).alias("r")
    )
    return spans.select(
        "id", "version", (F.col("first") + F.col("r.starts")).alias("from"), (F.col("first") + F.col("r.ends") + length).alias("to")
    )


def _counted_windows(segments: DataFrame, length: int, found: str) -> DataFrame:
    """The same answer as the merge, by counting the digests of all windows: no task needs a whole group."""

    def windows(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for gram, seg, n, count, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for at in range(count):
                    digest = xxhash.xxh3_128_digest(data[at : at + length])
                    row = gram, seg, n, at, digest
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            names = ["gram", "seg", "n", "at", "digest"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    one = segments.dropDuplicates(["gram", "seg"]).select("gram", "seg", "n", "windows", "bytes")
    digests = stored(one.mapInArrow(windows, "gram long, seg long, n long, at int, digest binary"))
    often = digests.groupBy("gram", "digest").agg(F.sum("n").alias("all")).where("all > 1").select("gram", "digest")
    hits = digests.where("n = 1").join(often, ["gram", "digest"]).groupBy("gram", "seg").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    return hits.select("gram", "seg", "starts", F.col("starts").alias("ends"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **bounds) -> DataFrame:
    """``id, n_bytes, spans, kept``: the maximal removed runs of bytes and what is left, joined."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    per_doc = (
        repeated_spans(rows, length, **bounds)
        .groupBy("id", "version")
        .agg(F.collect_set(F.struct("from", "to")).alias("found"))
        .select(F.col("id").alias("w_id"), F.col("version").alias("w_version"), "found")
    )
    joined = rows.join(per_doc, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("version") == F.col("w_version")), "left")

    def remove(batches):
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, runs, left, at = text.encode(), [], [], 0
                for a, b in sorted((f["from"], f["to"]) for f in found or ()):
                    if runs and a <= runs[-1]["to"]:
                        runs[-1]["to"] = max(b, runs[-1]["to"])
                    else:
                        runs.append({"from": a, "to": b})
                for r in runs:
                    left.append(data[at : r["from"]])
                    at = r["to"]
                left.append(data[at:])
                sizes.append(len(data))
                spans.append(runs)
                kept.append(b"".join(left))
            run = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, run), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.select("id", "text", "found").mapInArrow(
        remove, f"id {kind}, n_bytes long, spans array<struct<from: long, to: long>>, kept binary"
    )
