"""64-bit hashes of the words of many texts at once, straight from Arrow's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_rng = np.random.default_rng(20240229)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random value for each byte, 0 for white space, which so adds nothing to a word.
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C55
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2 ** 64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of one block; a text begins at each of ``cuts``."""
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    cuts = cuts[cuts < len(data)]
    start[cuts] |= solid[cuts]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, dtype=np.uint64), at
    power, inverse = _power(len(data))
    sums = np.add.reduceat(_VALUE[data] * power[: len(data)], at)
    return mix(sums * inverse[at]), at


def _blocks(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """A long text in pieces of about SLICE bytes, cut at white space."""
    while end - begin > SLICE:
        cut = begin + SLICE
        while cut < end:
            gap = np.flatnonzero(_SPACE[data[cut : min(end, cut + SLICE)]])
            if len(gap):
                cut += int(gap[0])
                break
            cut = min(end, cut + SLICE)
        yield begin, cut
        begin = cut
    yield begin, end


def words_of(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive slices of ``texts``: first and last + 1 text, the hashes of all their
    words, and where in these the words of each text begin (one more at the end).

    Words are what white space separates, without regard to case. A null is an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, len(texts))
        begin, end = int(offsets[i]), int(offsets[j])
        if end - begin > SLICE:  # one long text
            hashes = np.concatenate([_hash_block(data[a:b], np.zeros(1, dtype=np.int64))[0] for a, b in _blocks(data, begin, end)])
            bounds = np.array([0, len(hashes)])
        else:
            hashes, at = _hash_block(data[begin:end], offsets[i:j] - begin)
            bounds = np.searchsorted(at, offsets[i : j + 1] - begin)
        yield i, j, hashes, bounds
        i = j
