"""Blocks of documents that exchange their distinct words with a corpus-wide table.

A corpus has far fewer distinct words per block than words.  An operator that
needs a global answer for each word therefore sends every block's distinct
words once, packed by the part of the word table that answers them, and gets
the answers back per block.  A frequent word costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one task holds, about.
BLOCK_BYTES = 12 << 20


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``id, text, block`` and the number of blocks. Texts are compressed for the shuffle; a null text becomes empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def compress(batches):
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            text = pa.array([squeeze(t.as_py().encode()) for t in batch.column(1)], pa.binary())
            yield pa.record_batch([batch.column(0), text, batch.column(2)], names=["id", "text", "block"])

    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    return placed.mapInArrow(compress, f"id {docs.schema[id_col].dataType.simpleString()}, text binary, block int"), blocks


def texts_of(block: pa.Table) -> Iterator[str]:
    """The texts of a block, one at a time."""
    expand = zstandard.ZstdDecompressor().decompress
    for text in block.column("text"):
        yield expand(text.as_py()).decode()


def pack(**columns) -> bytes:
    """Columns of equal length as one compressed value."""
    batch = pa.record_batch(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(value: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(value).read_next_batch()
