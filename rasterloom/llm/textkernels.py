"""Vectorised numpy kernels over Arrow text: word spans, word hashes, byte n-grams.

A batch is cut into groups of whole documents of about ``MAX_BYTES``, so temporary arrays
stay bounded; one longer document is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import SEPARATORS

MAX_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


class _Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, MAX_BYTES + 1)
            inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, f, dtype=np.uint64)]), dtype=np.uint64) for f in (_MULTIPLIER, inverse))
        return self.up, self.down


_powers = _Powers()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(column: pa.Array, limit: int = MAX_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` for runs of documents of about ``limit`` bytes together."""
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a group of documents: spans, owners and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        self.raw, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        self.data = LOWER[data] if lower else data
        word = IS_WORD[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate([[False], word[:-1]]) if len(data) else word
        after = np.concatenate([word[1:], [False]]) if len(data) else word
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs)
        self._sums: np.ndarray | None = None

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, equal for equal bytes wherever they stand."""
        up, down = _powers.get(len(self.data) + 1)
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[self.data] * up[: len(self.data)], dtype=np.uint64)])
            return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def byte_ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ``n`` bytes inside documents: hashes and owners."""
    count = len(data) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = BYTE_CODES[data]
    with np.errstate(over="ignore"):
        out, factor = codes[:count].copy(), np.uint64(1)
        for k in range(1, n):
            factor = factor * _MULTIPLIER
            out += codes[k : k + count] * factor
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:count] == owner[n - 1 :]
    return mix(out[inside] + np.uint64(n)), owner[:count][inside]


def distinct_per_doc(owner: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(owner, feature)`` pairs, sorted; ``feature`` has at most ``bits`` bits."""
    pairs = np.unique((owner.astype(np.int64) << bits) | feature.astype(np.int64))
    return pairs >> bits, pairs & ((1 << bits) - 1)
