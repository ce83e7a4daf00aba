"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import re

import numpy as np

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, size=64 * 256, dtype=np.uint64)
_BYTES = 1 << 20
_BREAK = re.compile(rb"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; null becomes empty."""
    return text.encode().lower() if text else b""


def _hash_piece(piece: bytes) -> np.ndarray:
    data = np.frombuffer(piece, dtype=np.uint8)
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint64)
    size = end - start
    inner = np.flatnonzero(~gap)
    begin = np.zeros(len(size), dtype=np.int64)
    np.cumsum(size[:-1], out=begin[1:])
    at = np.arange(len(inner)) - np.repeat(begin, size)
    value = _TABLE[((at & 63) << 8) + data[inner]] * ((at >> 6) * 2 + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64))


def hash_words(folded: bytes) -> np.ndarray:
    """Hashes of the maximal runs of bytes other than space and 0x09-0x0D, in order."""
    if len(folded) <= _BYTES:
        return _hash_piece(folded)
    found, at = [], 0
    while at < len(folded):
        stop = at + _BYTES
        cut = _BREAK.search(folded, stop) if stop < len(folded) else None
        stop = cut.start() if cut else len(folded)
        found.append(_hash_piece(folded[at:stop]))
        at = stop
    return np.concatenate(found)


def hash_many(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and the places where each text's words begin and the last ends."""
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    found, group, size = [], [], 0

    def flush():
        # Texts are joined by a marker word of their own, so that one pass serves many short texts.
        hashed = _hash_piece(b" \x00\x00 ".join(group))
        marks = np.flatnonzero(hashed == _MARK)
        if len(marks) != len(group) - 1:  # a text holds the marker itself
            parts = [_hash_piece(t) for t in group]
            found.extend(parts)
            return [len(p) for p in parts]
        bounds = np.concatenate(([-1], marks, [len(hashed)]))
        found.append(np.delete(hashed, marks))
        return list(np.diff(bounds) - 1)

    n = 0
    for text in texts:
        if group and (size + len(text) > _BYTES or len(text) > _BYTES):
            sizes = flush()
            counts[n + 1 : n + 1 + len(sizes)] = sizes
            n += len(sizes)
            group, size = [], 0
        if len(text) > _BYTES:
            words = hash_words(text)
            found.append(words)
            counts[n + 1] = len(words)
            n += 1
        else:
            group.append(text)
            size += len(text)
    if group:
        sizes = flush()
        counts[n + 1 : n + 1 + len(sizes)] = sizes
    return (np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)), np.cumsum(counts)


_MARK = _hash_piece(b"\x00\x00")[0]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of k words, sorted; fewer words make one run of all."""
    if len(words) == 0:
        return words
    run = min(k, len(words))
    value = np.full(len(words) - run + 1, run, dtype=np.uint64)
    for i in range(run):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(value)])
    return np.unique(value)
