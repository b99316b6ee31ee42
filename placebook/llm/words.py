"""Words of Arrow text columns as arrays: no Python object per word.

A word is a run of bytes other than space and 0x09-0x0D. Texts are taken whole; a null text has
no words. Batches are cut into slices of a few megabytes between texts, so that memory does not
depend on the batch; a single long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Texts:
    """Texts back to back: ``data[bounds[i]:bounds[i + 1]]`` are the bytes of text i."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Words of texts: ``bounds[i]:bounds[i + 1]`` are text i's words; ``ids`` point into ``known``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray
    known: pa.Array

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every batch."""
        values = (xxhash.xxh3_64_intdigest(word) for word in self.known.to_pylist())
        return np.fromiter(values, np.uint64, len(self.known))[self.ids]

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def texts(column: pa.Array) -> Texts:
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return Texts(data, bounds - bounds[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text bounds of the runs of marked bytes; none crosses two texts."""
    firsts = bounds[:-1][np.diff(bounds) > 0]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[firsts] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[firsts[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def named(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers for pieces that lie back to back in ``data``, equal for equal pieces, and the pieces."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    pieces = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def words(given: Texts) -> Words:
    inside = ~SPACE[given.data]
    starts, ends, bounds = runs(inside, given.bounds)
    ids, known = named(given.data[inside], ends - starts)
    return Words(starts, ends, bounds, ids, known)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
