"""Vectorised scans over the UTF-8 bytes of Arrow text columns.

Words, chunks and shingles are found and hashed with whole-array NumPy
operations; no Python loop runs per word. A span's hash is a polynomial in a
fixed odd base modulo 2**64, read off prefix sums, then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20  # bytes hashed at once
GROUP = 2 << 20  # text bytes handled at once

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, grown when a longer window comes."""

    def __init__(self) -> None:
        self.size = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, WINDOW + 1)
            self.up, self.down = _powers(_BASE, self.size), _powers(pow(_BASE, -1, 1 << 64), self.size)
        return self.up, self.down


_TABLES = _Tables()
_rng = np.random.default_rng(20240501)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and the row offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_groups(batch: pa.RecordBatch, text: str, most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if len(sizes) > first:
        yield batch.slice(first)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are ascending and do not overlap."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + WINDOW, "right")))
        hi = int(ends[j - 1])
        up, down = _TABLES.get(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; rows part words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: hash, start, end; and each row's first word (rows + 1 entries)."""
    starts, ends = word_spans(buf, offsets)
    hashes = hash_spans(buf, starts, ends, LOWER_CODES if lower else BYTE_CODES)
    return hashes, starts, ends, np.searchsorted(starts, offsets, "left")


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter sequence is one run."""
    n = len(hashes)
    if not n:
        return hashes
    width_now = min(n, width)
    out = np.zeros(n - width_now + 1, np.uint64)
    for k in range(width_now):
        out += hashes[k : n - width_now + 1 + k] * np.uint64(pow(0xA24BAED4963EE407, k + 1, 1 << 64))
    return mix(out + np.uint64(width_now))
