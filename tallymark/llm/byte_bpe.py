"""Byte-level BPE encoding by a shuffle of the distinct words, and decoding.

Texts are cut into words by the tokenizer's pattern.  Each block of documents
sends its distinct words to the word's part of the corpus-wide vocabulary,
where every distinct word is merged once, whichever block sent it.  The ids go
back to the blocks and are laid out by position.  Decoding looks ids up in the
table of token bytes, whose size is that of the vocabulary file.

Defined cases: a null or empty text has no ids and decodes to no bytes.  Words
of any length are merged.  Repeated rows are encoded one by one.  An empty
table gives an empty result.  Columns other than the two named ones are not
looked at.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.blocks import BLOCK_BYTES, in_blocks, pack, texts_of, unpack

#: Pieces longer than this are merged with a heap.
_SHORT = 48
#: Tokens that are decoded at a time.
_DECODED = 1 << 19


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in the order of their ranks, from a rank file of base64 tokens."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found.get(i, b"") for i in range(max(found) + 1)]


class Splitter:
    """Cuts text into words by a pattern with ``\\s``, ``\\p{L}`` and ``\\p{N}``; pure ASCII takes an equal, faster form."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self._compile()

    def _compile(self):
        inside = {r"\s": "\\t-\\r ", r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}

        def in_class(m):
            body = m.group(0)
            for a, b in inside.items():
                body = body.replace(a, b)
            return body

        ascii_form = re.sub(r"\[[^\]]*\]", in_class, self.pattern)
        for a, b in inside.items():
            ascii_form = ascii_form.replace(a, f"[{b}]")
        self._ascii = re.compile(ascii_form.replace(r"\S", "[^\\t-\\r ]"))
        self._any = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def __call__(self, text: str) -> list[str]:
        return (self._ascii if text.isascii() else self._any).findall(text)

    def __reduce__(self):
        return Splitter, (self.pattern,)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is joined first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > _SHORT:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list, ranks: dict[bytes, int]) -> list[int]:
    n = len(parts)
    after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(queue)

    def offer(i):
        if i >= 0 and after[i] < n:
            j = after[i]
            rank = ranks.get(parts[i] + parts[j])
            if rank is not None:
                heapq.heappush(queue, (rank, i, parts[i], parts[j]))

    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < n:
            ahead[after[i]] = i
        offer(ahead[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id, ids``: the token ids of each text as an array of int."""
    blocked, parts = in_blocks(docs, id_col, text_col, block_bytes)
    # The vocabulary file bounds this broadcast.
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    split = Splitter(pattern)

    def distinct_words(key, block):
        words: set[str] = set()
        for text in texts_of(block):
            words.update(split(text))
        by_part: dict[int, list[bytes]] = {}
        for word in words:
            raw = word.encode()
            by_part.setdefault(zlib.crc32(raw) % parts, []).append(raw)
        packed = [pack(word=pa.array(sorted(w), pa.binary())) for w in by_part.values()]
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(by_part), pa.int32()),
                "part": pa.array(list(by_part), pa.int32()),
                "words": pa.array(packed, pa.binary()),
            }
        )

    def encode_part(key, sent):
        ranks = {t: i for i, t in enumerate(tokens.value) if t}
        known: dict[bytes, list[int]] = {}
        answers = []
        for blob in sent.column("words"):
            words = unpack(blob.as_py()).column("word")
            ids = []
            for word in words.to_pylist():
                found = known.get(word)
                if found is None:
                    found = known[word] = merge(word, ranks)
                ids.append(found)
            answers.append(pack(word=words, ids=pa.array(ids, pa.list_(pa.int32()))))
        return pa.table({"block": sent.column("block"), "answers": pa.array(answers, pa.binary())})

    def lay_out(block, answered):
        coded: dict[str, bytes] = {}
        for blob in answered.column("answers"):
            batch = unpack(blob.as_py())
            ids = batch.column("ids")
            flat = ids.values.to_numpy().astype("<i4").tobytes()
            ends = ids.offsets.to_numpy() * 4
            for k, word in enumerate(batch.column("word").to_pylist()):
                coded[word.decode()] = flat[ends[k] : ends[k + 1]]
        chunks = [b"".join([coded[w] for w in split(text)]) for text in texts_of(block)]
        ends = np.zeros(len(chunks) + 1, dtype=np.int64)
        np.cumsum([len(c) // 4 for c in chunks], out=ends[1:])
        ids = pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(chunks), dtype="<i4"))
        return pa.table({"id": block.column("id"), "ids": ids.cast(pa.list_(pa.int32()))})

    sent = blocked.groupBy("block").applyInArrow(distinct_words, "block int, part int, words binary")
    answered = sent.groupBy("part").applyInArrow(encode_part, "block int, answers binary")
    id_type = docs.schema[id_col].dataType.simpleString()
    return blocked.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(lay_out, f"id {id_type}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def look_up(batches):
        table = pa.array(tokens.value, pa.large_binary())
        nothing = pa.scalar(b"", pa.large_binary())
        for whole in batches:
            at = whole.schema.get_field_index(ids_col)
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            row = 0
            while row < whole.num_rows:
                # Rows of about so many tokens at a time; a longer text is alone.
                past = sizes[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(sizes, past + _DECODED, "right")))
                batch = whole.slice(row, stop - row)
                pieces = table.take(batch.column(at).flatten())
                ends = np.concatenate(([past], sizes[row:stop])) - past
                found = pc.binary_join(pa.LargeListArray.from_arrays(ends, pieces), nothing).cast(pa.binary())
                yield batch.append_column(out_col, found)
                row = stop

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(look_up, f"{fields}, `{out_col}` binary")


def digests(coded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded texts, and the columns in ``keep``."""
    return coded.select(
        "id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *keep,
    )
