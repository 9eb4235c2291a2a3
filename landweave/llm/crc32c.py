"""CRC-32C (Castagnoli) of many byte strings at once, in numpy, and the mask that keeps a
stored checksum from being mistaken for data."""

from __future__ import annotations

import numpy as np

CHUNK = 64


def _tables(n: int) -> np.ndarray:
    """Row i: what byte b contributes if i more zero bytes follow it."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0x82F63B78) ^ (t >> np.uint32(1)), t >> np.uint32(1)).astype(np.uint32)
    rows = [t]
    for _ in range(n - 1):
        rows.append(t[rows[-1] & 255] ^ (rows[-1] >> np.uint32(8)))
    return np.array(rows)


_T = _tables(CHUNK)


def _advance(state: np.ndarray, by: int) -> np.ndarray:
    """The state after ``by`` zero bytes, 4 <= by <= CHUNK."""
    return _T[by - 1][state & 255] ^ _T[by - 2][state >> 8 & 255] ^ _T[by - 3][state >> 16 & 255] ^ _T[by - 4][state >> 24]


def crc32c(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each ``data[bounds[i]:bounds[i + 1]]``; every one has 4 bytes at least.

    Each string is padded in front to whole chunks, which leaves a register that starts at
    zero as it is; the usual start at all ones is an inversion of the first 4 bytes.
    All chunks run in step, then those of each string are joined in order.
    """
    size = np.diff(bounds)
    if not len(size):
        return np.empty(0, dtype=np.uint32)
    chunks = -(-size // CHUNK)
    last = np.cumsum(chunks)
    padded = np.zeros(int(last[-1]) * CHUNK, dtype=np.uint8)
    shift = last * CHUNK - bounds[1:]
    padded[np.arange(bounds[0], bounds[-1]) + np.repeat(shift, size)] = data[bounds[0] : bounds[-1]]
    head = (bounds[:-1] + shift)[:, None] + np.arange(4)
    padded[head] ^= 255
    words = padded.view("<u4").reshape(-1, CHUNK // 4)
    state = np.zeros(len(words), dtype=np.uint32)
    for k in range(CHUNK // 4):
        state = _advance(state ^ words[:, k], 4)
    order = np.argsort(-chunks, kind="stable")
    first, chunks = (last - chunks)[order], chunks[order]
    total = state[first].copy()
    active = len(order)
    for k in range(1, int(chunks[0])):
        active = int(np.searchsorted(-chunks[:active], -k, "left"))  # those with more than k chunks
        total[:active] = _advance(total[:active], CHUNK) ^ state[first[:active] + k]
    out = np.empty(len(size), dtype=np.uint32)
    out[order] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)
