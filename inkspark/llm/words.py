"""Vectorised words of Arrow text columns.

A word is a run of bytes outside {0x20, 0x09-0x0D}. Bytes are hashed with position weights, so that
a prefix sum gives the hash of any span in constant time: no Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Fixed pseudo-random weights: one for each byte, a base and its inverse modulo 2**64.
BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def apart(df: DataFrame, *names: str) -> list[str]:
    """Names for own columns that no column of `df` has, whatever the letter case."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def trimmed() -> None:
    """Gives freed memory back to the system: a worker keeps what its largest batch took otherwise."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        if n > 1 << 23:
            have = np.full(n, base, np.uint64)
            have[:1] = 1
            return np.cumprod(have, dtype=np.uint64)
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `limit` bytes of text (one row at least), the bytes and row offsets."""
    for batch in batches:
        col = batch.column(text)
        col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
        if col.null_count:
            col = col.fill_null("")
        n = len(col)
        if not n:
            continue
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


class Words:
    """Words of a chunk: byte `start` and `end`, `row`, and lazily their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~space[data]
        step = np.diff(inside)
        first = step[:-1] == 1
        last = step[1:] == -1
        # A row's edge ends a word even where two rows' bytes touch.
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        both = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
        first[both] = True
        last[both - 1] = True
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self._sum: np.ndarray | None = None

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, the same for the same bytes anywhere."""
        if self._sum is None:
            self._sum = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE[self.data] * powers(BASE, len(self.data)), out=self._sum[1:])
        back = powers(INVERSE, len(self.data) + 1)
        return mix((self._sum[end] - self._sum[start]) * back[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def shingles(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of `k` words in a row within one text, and their first words' indices."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = hashes[: n - k + 1].copy()
        for j in range(1, k):
            out = mix(out * U64(0x2545F4914F6CDD1D) + hashes[j : n - k + 1 + j])
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return out[at], at
