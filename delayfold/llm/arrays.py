"""Texts of an Arrow batch as numpy arrays, with hashes of any byte range.

All operators that need Python walk a batch in chunks of whole texts, so memory is bounded by the
chunk size and the longest single text. Nothing here keeps state between tasks but constants.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE ^= np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << n.bit_length(), CHUNK_BYTES + 4096)
        for i, base in enumerate((_R, _R_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """64-bit hashes of byte ranges of one array; equal bytes give equal hashes everywhere."""

    def __init__(self, data: np.ndarray):
        powers, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[:-1], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all ranges of one length, by start."""
        raw = (self._sums[length:] - self._sums[:-length]) * self._inverse[: len(self._sums) - length]
        return mix(raw + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


@dataclass
class Chunk:
    """Some rows of a batch: their texts back to back, text i in data[offsets[i]:offsets[i + 1]]."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.null)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def column(self, name: str) -> pa.Array:
        return self.rows.column(name)


def hand_back() -> None:
    """Returns memory that Arrow and the C library keep after it was freed: an idle worker needs none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[Chunk]:
    """Chunks of whole texts with at most `limit` bytes, or one longer text; null texts are empty.

    Workers live on between tasks, so what is kept for later goes back when the texts are through.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        if not pa.types.is_large_binary(texts.type):
            texts = texts.cast(pa.large_binary())
        null = np.asarray(texts.is_null())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(texts):
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), len(texts))
            low, high = int(offsets[start]), int(offsets[end])
            yield Chunk(
                batch.slice(start, end - start),
                data[low:high],
                offsets[start : end + 1] - low,
                null[start:end],
            )
            start = end
    hand_back()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    """Words of a chunk in order; words of text i are numbers first[i] to first[i + 1] - 1."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of bytes that are not ASCII white space; a text's end also ends a word."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return Words(starts, ends, np.searchsorted(starts, offsets))


def sums_of(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of `flags` within each [bounds[i], bounds[i + 1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of a fixed-width array as a binary column."""
    width = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(bounds) - 1,
        [None, pa.py_buffer((np.asarray(bounds, np.int64) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(values))],
    ).cast(pa.binary())


def list_rows(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
