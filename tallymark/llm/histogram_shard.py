"""Sharding by histogram sort.

Rows are ordered by a hash key.  Every shard border starts as the whole key
space and is refined: each round counts the exact bytes below many probe keys
across all partitions and keeps the cell that holds the wanted share, until the
cell is within the tolerance.  Then the rows are exchanged once.

Defined cases: a null text has no bytes and counts 1.  Equal (identifier, text)
rows have equal keys and stay together.  An empty table gives an empty result.
Columns other than the named ones are carried only when listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import stored

#: Probes per border and round; what a round brings to the driver is shards times this.
PROBES = 512
#: A border may miss its share by this part of a shard.
TOLERANCE = 0.0005
#: Rows that one task numbers, about.
NUMBERED_ROWS = 50_000
_SPACE = 1 << 63


def text_size(text):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def byte_splitters(light: DataFrame, shards: int, probes: int = PROBES, tolerance: float = TOLERANCE) -> list[int]:
    """Border keys of a table of (key in [0, 2^63), size) such that each shard gets near its share of all bytes."""
    total = light.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    cells = {i: (0, _SPACE, 0) for i in range(1, shards)}  # border -> from, to, bytes below from
    found: dict[int, int] = {}
    while cells and total:
        spans = sorted({(lo, hi) for lo, hi, _ in cells.values()})
        step = {s: -(-(s[1] - s[0]) // probes) for s in spans}
        key = F.col("key")

        def within(s):
            return (key >= s[0]) & (key <= s[1] - 1)  # noqa: B023

        active = reduce(lambda a, b: a | b, map(within, spans))
        which = reduce(lambda a, i: a.when(within(spans[i]), F.lit(i)), range(1, len(spans)), F.when(within(spans[0]), F.lit(0)))
        cell = reduce(
            lambda a, s: a.when(within(s), F.expr(f"(key - {s[0]}L) div {step[s]}L")),
            spans[1:],
            F.when(within(spans[0]), F.expr(f"(key - {spans[0][0]}L) div {step[spans[0]]}L")),
        )
        rows = (
            light.where(active)
            .select(which.alias("span"), cell.alias("cell"), "size")
            .groupBy("span", "cell")
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            .collect()
        )
        counted: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["span"], r["cell"])):
            counted.setdefault(r["span"], []).append((r["cell"], r["bytes"], r["rows"]))
        for i, (lo, hi, below) in list(cells.items()):
            want = i * total / shards
            for c, size, n in counted.get(spans.index((lo, hi)), []):
                if below + size >= want:
                    break
                below += size
            width = step[(lo, hi)]
            new = lo + c * width, min(hi, lo + (c + 1) * width), below
            if n == 1 or size <= allowed or new[1] - new[0] <= 1:
                found[i] = new[0] if want - below < below + size - want else new[1]
                del cells[i]
            else:
                cells[i] = new
    return [found[i] for i in sorted(found)]


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``id, size, shard, slot`` and the carried columns; the shards have near equal bytes and gapless slots from 0."""
    text = F.col(text_col)
    key = F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 1)
    rows = docs.select(
        key.alias("key"), F.col(id_col).alias("id"), text_size(text).alias("size"), *(F.col(c).alias(f"with_{c}") for c in carry)
    )
    light = stored(rows.select("key", "size"))
    borders = byte_splitters(light, shards)
    shard = reduce(lambda a, b: a + (F.col("key") >= b).cast("int"), [x for x in borders if x < _SPACE], F.lit(0))
    # Slots are counted per slice of the key space, so that no task numbers a whole shard.
    bits = max(4, (light.count() // NUMBERED_ROWS).bit_length() + 1)
    cut = F.shiftrightunsigned("key", 63 - bits)
    sliced = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        light.select(shard.alias("shard"), cut.alias("slice"))
        .groupBy("shard", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "slice", F.coalesce(F.sum("n").over(sliced), F.lit(0)).alias("before"))
    )
    place = Window.partitionBy("shard", "slice").orderBy("key", F.asc_nulls_first("id"))
    return (
        rows.select("*", shard.alias("shard"), cut.alias("slice"))
        .withColumn("at", F.row_number().over(place) - 1)
        .join(before, ["shard", "slice"])
        .select("id", "size", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), *(F.col(f"with_{c}").alias(c) for c in carry))
    )
