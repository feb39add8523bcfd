"""Words of Arrow text columns as NumPy arrays, without a Python object for each word.

Python workers only: nothing here touches Spark.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash

_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
#: Words are hashed in runs of about so many bytes; a longer word than _LONG is hashed alone.
_RUN, _LONG = 1 << 20, 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; equal for equal input, and one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins and the last ends; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    left, right = np.empty(n, bool), np.empty(n, bool)
    left[0], left[1:] = False, solid[:-1]
    right[-1], right[:-1] = False, solid[1:]
    left[at[:-1][at[:-1] < n]] = False
    right[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~left), np.flatnonzero(solid & ~right) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _RUN + _LONG + 1
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, p, np.uint64))]) for p in (_ODD, _INV))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, wherever it stands."""
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > _LONG)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    todo = np.setdiff1d(np.arange(len(starts)), long, assume_unique=True) if len(long) else slice(None)
    s, e = starts[todo], ends[todo]
    got = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        k = max(i + 1, int(np.searchsorted(s, s[i] + _RUN)))
        base, stop = s[i], e[k - 1]
        # A word begins less than _RUN bytes after the first one of its run and is at most _LONG bytes long.
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=sums[1:])
        a, b = s[i:k] - base, e[i:k] - base
        got[i:k] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = k
    out[todo] = mix(got)
    return out


def firsts(counts: np.ndarray) -> np.ndarray:
    """Where each group begins when groups of these sizes stand one after another."""
    return np.cumsum(counts) - counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``width`` words, the number of its text and a 64-bit hash; of a shorter text, all its words."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(hashes):
        return owner, np.zeros(0, np.uint64)
    left = (firsts(counts) + counts)[owner] - np.arange(len(hashes))
    begin = np.flatnonzero((left >= width) | (left == counts[owner]))
    have = np.minimum(left[begin], width)
    total = have.astype(np.uint64)
    for j in range(width):
        got = hashes[np.minimum(begin + j, len(hashes) - 1)]
        total = mix(total * np.uint64(_ODD) + np.where(j < have, got, np.uint64(0)))
    return owner[begin], total


class Index:
    """Finds 64-bit keys in a sorted array of different ones, by their upper bits and then step by step.

    A random key is found in two or three steps, where a binary search would take twenty.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.begin = np.searchsorted(keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key a place, and whether the key is there."""
        if not len(self.keys):
            return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
        group = (sought >> self.shift).astype(np.int64)
        at, end = self.begin[group], self.begin[group + 1]
        last = len(self.keys) - 1
        at = np.minimum(at, last)
        go = np.flatnonzero((at < end - 1) & (self.keys[at] < sought))
        while len(go):
            at[go] += 1
            here = at[go]
            go = go[(here < end[go] - 1) & (self.keys[here] < sought[go])]
        return at, self.keys[at] == sought
