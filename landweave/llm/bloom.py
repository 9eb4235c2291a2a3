"""Blocked-free Bloom filters over 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class Bloom:
    """``bits`` (a power of two) bits, ``probes`` of them for each hash."""

    def __init__(self, bits: int, probes: int = 6, data: bytes | None = None):
        self.shift, self.probes = np.uint64(64 - (bits.bit_length() - 1)), probes
        self.data = np.zeros(bits >> 3, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)

    @classmethod
    def sized(cls, n: int, bits_each: int = 10, probes: int = 6) -> Bloom:
        """With room for n hashes: at least ``bits_each`` bits for each."""
        return cls(1 << max(6, int(n * bits_each - 1).bit_length() if n else 6), probes)

    def _bits(self, hashes: np.ndarray):
        for m in _MULTIPLIERS[: self.probes]:
            x = hashes * m
            at = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> self.shift
            yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for byte, bit in self._bits(hashes):
            np.bitwise_or.at(self.data, byte, bit)

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for byte, bit in self._bits(hashes):
            found &= self.data[byte] & bit != 0
        return found
