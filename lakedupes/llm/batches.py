"""Texts of an Arrow batch as one byte buffer, and their words as arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once inside a task; one longer text is worked on alone.
SLICE_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def slices(
    batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about ``size`` bytes of ``column``."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(column))
        start = 0
        while start < batch.num_rows:
            limit = offsets[start] + size
            end = max(start + 1, int(np.searchsorted(offsets, limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the n + 1 offsets of the texts in them. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    array = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[first:last] if data and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def byte_set(*members: int | tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans; a pair is an inclusive range."""
    table = np.zeros(256, bool)
    for m in members:
        low, high = m if isinstance(m, tuple) else (m, m)
        table[low:high + 1] = True
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_BASE), -1, 2**64))

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES * 2)
            self.up = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
            self.down = np.multiply.accumulate(np.full(n, self.inverse, np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range ``data[start:end]``; equal ranges have equal hashes."""
    up, down = _POWERS.to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def words(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs without separators inside each text."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(
    word: np.ndarray, owner: np.ndarray, n_texts: int, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and their texts, in order.

    A text with fewer words, but not none, has one shingle of all its words.
    """
    count = np.bincount(owner, minlength=n_texts)
    odd = [np.uint64(0xD6E8FEB86659FD93 + 2 * k * 0x5851F42D4C957F2D & (2**64 - 1)) | np.uint64(1)
           for k in range(size)]
    m = len(word) - size + 1
    hashes = np.zeros(0, np.uint64)
    owners = np.zeros(0, np.int64)
    if m > 0:
        whole = owner[:m] == owner[size - 1:]
        total = np.zeros(m, np.uint64)
        for k in range(size):
            total += word[k:k + m] * odd[k]
        hashes, owners = mix(total)[whole], owner[:m][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count) - count
        total = count[short].astype(np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            total[has] += word[first[short[has]] + k] * odd[k]
        hashes = np.concatenate((hashes, mix(total)))
        owners = np.concatenate((owners, short))
    return hashes, owners


def distinct_sets(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted by text, then hash."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new]


def lists(values: np.ndarray, owners: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """One list per text from values sorted by text."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
