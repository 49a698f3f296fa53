"""Two-stage suffix sorting of many short texts at once, to a depth of ``depth`` bytes."""

from __future__ import annotations

import numpy as np


def _sorted_rows(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns; each column is looked at only where those before it leave rows equal."""
    order = np.argsort(columns[0])
    first = columns[0][order]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = first[1:] != first[:-1]
    for column in columns[1:]:
        tied = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(tied):
            break
        rows, run = order[tied], np.cumsum(new[tied])
        value = column[rows]
        by_run = np.lexsort((value, run))
        value = value[by_run]
        order[tied] = rows[by_run]
        new[tied[1:]] |= value[1:] != value[:-1]
    return order


def two_stage_order(data: np.ndarray, lengths: np.ndarray, starts_per_text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions (the first ``starts_per_text`` of each text), sorted by their first ``depth`` bytes.

    Suffixes are of type A where they are larger than their successor by the first byte, else of type B.
    Only type B is sorted directly. Type A is induced: buckets of first bytes are scanned upwards, and each suffix
    found puts its type A predecessor behind those already in the bucket of its byte; in a bucket, type A comes before
    type B. A text ends with a sentinel below all bytes. Beyond the suffixes asked for, those up to the next one of
    type B take part, so that each type A suffix has its successor.
    """
    n_texts = len(lengths)
    ends = np.cumsum(lengths + 1)
    begin = ends - lengths - 1
    text = np.zeros(int(ends[-1]) if n_texts else 0, np.int16)
    inner = np.arange(len(data)) + np.repeat(np.arange(n_texts), lengths)
    text[inner] = data.astype(np.int16) + 1
    following = np.append(text[1:], 0)
    larger = text > following
    larger[ends - 1] = False
    # The next suffix of type B from each position on; a sentinel is one.
    place = np.where(larger, len(text), np.arange(len(text)))
    next_b = np.minimum.accumulate(place[::-1])[::-1]
    stop = next_b[np.minimum(begin + starts_per_text, ends - 1)] + 1
    n = len(text) + 1
    used = np.cumsum(np.bincount(begin, minlength=n) - np.bincount(stop, minlength=n))[:-1] > 0
    direct = np.flatnonzero(used & ~larger)
    padded = np.zeros(len(text) + depth + 8, np.uint8)
    padded[inner] = data
    blocks = -(-depth // 8)
    keys = [
        np.lib.stride_tricks.sliding_window_view(padded[8 * k:], 8)[direct].copy().view(">u8").ravel().astype(np.uint64)
        for k in range(blocks)
    ]
    # Sentinels come first, in any order: no more than their sentinel is compared.
    plain = text[direct] > 0
    direct = np.concatenate((direct[~plain], direct[plain][_sorted_rows([k[plain] for k in keys])]))
    first_of = np.searchsorted(text[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for byte in range(257):
        bucket = np.concatenate([*waiting[byte], direct[first_of[byte]:first_of[byte + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[larger[before] & used[before]]
        if len(before):
            byte_of = text[before]
            order = np.argsort(byte_of, kind="stable")
            before, byte_of = before[order], byte_of[order]
            cuts = np.flatnonzero(np.diff(byte_of)) + 1
            for part, b in zip(np.split(before, cuts), byte_of[np.concatenate(([0], cuts))], strict=True):
                waiting[b].append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n_texts), lengths + 1)[order]
    asked = order - begin[owner] < starts_per_text[owner]
    # Positions without the sentinels.
    return order[asked] - owner[asked]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it, ``depth`` at most; 0 for the first.

    Every suffix must have ``depth`` bytes.
    """
    out = np.zeros(len(order), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(data, depth) if len(data) >= depth else None
    for at in range(1, len(order), 50_000):
        rows = view[order[at - 1:at + 50_000]]
        differ = rows[1:] != rows[:-1]
        out[at:at + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out
