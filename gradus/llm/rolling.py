"""Numpy helpers: hashes of any span of a byte buffer, and runs of equal keys in Arrow streams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    return _powers(1 << max(20, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """64-bit hashes of spans of a buffer: equal bytes have equal hashes wherever they stand."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[:len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal integer ``keys`` (the stream is sorted by
    them) and the row where each run starts; tables have ``least`` rows or more but for
    the last.  What is held is bounded by a batch, ``least`` and the longest run."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def starts(table: pa.Table) -> np.ndarray:
        cut = np.zeros(table.num_rows, bool)
        cut[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            cut[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(cut)

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at[:-1]
            table = table.slice(at[-1])
        held, rows = table.to_batches(), table.num_rows
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)
