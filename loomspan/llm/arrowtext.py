"""Words and word windows of whole Arrow batches, as numpy arrays.

Nothing here loops over words: a batch's UTF-8 bytes are split at white space
with masks, and words and windows get 64-bit polynomial hashes from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd bases of the byte and word polynomials (modulo 2**64).
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_M = (1 << 64) - 1
#: Space, and tab to carriage return.
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are worked on at once.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (self._powers(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)


_bytes, _words = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def _prefix(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers, out=out[1:])
    return out


@dataclass
class Words:
    """The words of some documents: byte spans, hashes, and where each document's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    hashes: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.ptr) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, hash) of every window of k words that lies in one document."""
        n = len(self.hashes)
        if n < k:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        up, down = _words.get(n)
        total = _prefix(self.hashes, up)
        rolled = (total[k:] - total[:-k]) * down[: n - k + 1]
        doc = self.doc_of()
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        return doc[at], at, mix(rolled[at] + np.uint64(k))

    def whole(self) -> np.ndarray:
        """The hash of each document's whole word sequence."""
        n = len(self.hashes)
        up, down = _words.get(max(n, 1))
        total = _prefix(self.hashes, up[:n])
        first = np.minimum(self.ptr[:-1], max(n - 1, 0))
        rolled = (total[self.ptr[1:]] - total[self.ptr[:-1]]) * down[first]
        return mix(rolled + self.counts.astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return found[at[0] : at[-1]], at - at[0]


def split_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, separators: np.ndarray = _SEPARATORS) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, or runs of bytes that are no `separators`; fold lower-cases A-Z and nothing else."""
    if fold:
        upper = (data >= 65) & (data <= 90)
        data = data + (upper.view(np.uint8) << 5)
    inside = ~separators[data]
    first = inside.copy()
    last = inside.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _bytes.get(max(len(data), 1))
    total = _prefix(data.astype(np.uint64) + np.uint64(1), up[: len(data)])
    hashes = mix((total[end] - total[start]) * down[start]) if len(start) else np.zeros(0, np.uint64)
    return Words(data, start, end, np.searchsorted(start, offsets), hashes)


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(part, part[at], "right")))
        yield batch.slice(at, to - at)
        at = to


def batch_words(batch: pa.RecordBatch, text: str = "text", fold: bool = False) -> Words:
    return split_words(*text_bytes(batch.column(batch.schema.get_field_index(text))), fold=fold)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))
