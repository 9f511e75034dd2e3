"""Elias-Fano codes of nondecreasing integers, with select by a directory of 32-bit counts.

n values up to u take n * (2 + log2(u / n)) bits at most, and one 32-bit count
for every 512 bits of the upper half; nothing holds a 64-bit number for each value.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of the upper half that one entry of the directory counts.
BLOCK = 512
_HEAD = struct.Struct("<QQBQ")


def _pack(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    spread = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """The code of nondecreasing unsigned integers."""
    values = np.asarray(values).astype(np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    upper = np.zeros(-(-(int(high[-1]) + 1 if n else 0) // BLOCK) * BLOCK, np.uint8)
    upper[high] = 1
    upper = np.packbits(upper, bitorder="little").tobytes()
    low = _pack(values & np.uint64((1 << bits) - 1), bits)
    return _HEAD.pack(n, len(low), bits, len(upper)) + low + upper


class EliasFano:
    """Random access to a code: `get` selects; the code itself is never expanded."""

    def __init__(self, code: bytes | memoryview, at: int = 0):
        self.n, low, self.bits, upper = _HEAD.unpack_from(code, at)
        at += _HEAD.size
        self.low = np.frombuffer(code, np.uint8, low, at)
        self.upper = np.frombuffer(code, np.uint8, upper, at + low).reshape(-1, BLOCK // 8)
        self.size = _HEAD.size + low + upper
        self.before = np.zeros(len(self.upper) + 1, np.uint32)
        np.cumsum(np.bitwise_count(self.upper).sum(1, dtype=np.uint32), out=self.before[1:])

    def _lower(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), np.uint64)
        for b in range(self.bits):
            at = k * self.bits + b
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def get(self, k: np.ndarray) -> np.ndarray:
        """The values at positions k."""
        k = np.atleast_1d(np.asarray(k, np.int64))
        out = np.empty(len(k), np.uint64)
        for i in range(0, len(k), 4096):
            part = k[i:i + 4096]
            block = np.searchsorted(self.before, part, "right") - 1
            ones = np.cumsum(np.unpackbits(self.upper[block], axis=1, bitorder="little"), axis=1, dtype=np.int16)
            within = np.argmax(ones > (part - self.before[block])[:, None], axis=1)
            high = block * BLOCK + within - part
            out[i:i + 4096] = high.astype(np.uint64) << np.uint64(self.bits) | self._lower(part)
        return out
