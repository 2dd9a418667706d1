"""Equal byte strings of a batch get one slot of an open-addressed NumPy table.

A key is the xxhash64 of the bytes; a slot is shared only by strings whose bytes are equal, so colliding hashes cost a
probe and nothing else. All work is on arrays of starts and lengths in one byte buffer.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text interned together; a longer text is taken alone.
BATCH_BYTES = 1 << 20
#: Strings from this length on are hashed by the library, and compared one by one.
LONG = 32

# The primes of xxhash64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def byte_map(words: bytes) -> np.ndarray:
    """A table that sends A-Z to a-z, keeps the bytes that words may hold and makes a space of every other."""
    table = np.full(256, 0x20, np.uint8)
    keep = np.frombuffer(words, np.uint8)
    table[keep] = keep
    upper = np.arange(ord("A"), ord("Z") + 1)
    table[upper] = table[upper + 32]
    return table


def batches_of(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) over consecutive texts of about `most` bytes; null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


class Spans:
    """Words of several texts: word j is data[start[j]:start[j] + length[j]], text i has words first[i] to first[i + 1] - 1.

    A word is a run of bytes that the table doesn't send to a space.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data = data = table[raw]
        n = len(data)
        inside = data != 0x20
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:n]
        closes[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(opens)
        self.length = np.flatnonzero(closes) + 1 - self.start
        self.first = np.searchsorted(self.start, offsets)

    def grams(self, n: int) -> Spans:
        """Runs of n consecutive words of a text, joined by one space."""
        if n == 1:
            return self
        out = object.__new__(Spans)
        size = self.length + 1
        ends = np.cumsum(size)
        begin = ends - size
        out.data = self.data[np.minimum(np.repeat(self.start - begin, size) + np.arange(size.sum()), len(self.data) - 1)] if len(size) else self.data
        out.data[ends - 1] = 0x20
        count = np.maximum(np.diff(self.first) - n + 1, 0)
        out.first = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.first[:-1] - out.first[:-1], count) + np.arange(out.first[-1])
        out.start = begin[at]
        out.length = ends[at + n - 1] - 1 - out.start
        return out

    def text(self, j: int) -> bytes:
        return self.data[self.start[j]:self.start[j] + self.length[j]].tobytes()


def _lanes(data: np.ndarray, kind: str) -> np.ndarray:
    """A view of data that has the number of that kind at each byte; data has eight bytes to spare."""
    return np.ndarray((len(data) - 7,), kind, data, strides=(1,))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The xxhash64 of each string, seed 0."""
    data = np.append(data, np.zeros(8, np.uint8))
    eight, four = _lanes(data, "<u8"), _lanes(data, "<u4")
    h = length.astype(np.uint64) + P5
    for lane in range(LONG // 8):
        i = np.flatnonzero((length >= 8 * (lane + 1)) & (length < LONG))
        if len(i):
            h[i] = _turn(h[i] ^ _turn(eight[start[i] + 8 * lane] * P2, 31) * P1, 27) * P1 + P4
    at = start + length // 8 * 8
    i = np.flatnonzero((length % 8 >= 4) & (length < LONG))
    h[i] = _turn(h[i] ^ four[at[i]].astype(np.uint64) * P1, 23) * P2 + P3
    at[i] += 4
    for _ in range(3):
        i = np.flatnonzero((at < start + length) & (length < LONG))
        h[i] = _turn(h[i] ^ data[at[i]].astype(np.uint64) * P5, 11) * P1
        at[i] += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length >= LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + length[i]].tobytes())
    return h


def _equal(data: np.ndarray, eight: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the strings of that length at a and at b have the same bytes."""
    same = np.ones(len(a), bool)
    for lane in range(LONG // 8):
        rest = length - 8 * lane
        i = np.flatnonzero(same & (rest > 0) & (length < LONG))
        if not len(i):
            break
        unlike = eight[a[i] + 8 * lane] ^ eight[b[i] + 8 * lane]
        over = np.maximum(8 - rest[i], 0).astype(np.uint64) * np.uint64(8)
        same[i] = unlike << over == 0
    for i in np.flatnonzero(length >= LONG):
        same[i] = a[i] == b[i] or np.array_equal(data[a[i]:a[i] + length[i]], data[b[i]:b[i] + length[i]])
    return same


class Table:
    """An open-addressed table of the distinct strings of spans, at most half full, with linear probing.

    `slot` has each occurrence's slot, `used` the slots in use, `holder` an occurrence of each used slot's string and
    `count` how many occurrences it has.
    """

    def __init__(self, spans: Spans):
        n = len(spans.start)
        mask = (1 << max(4, (2 * n).bit_length())) - 1
        key = xxhash64(spans.data, spans.start, spans.length)
        data = np.append(spans.data, np.zeros(8, np.uint8))
        eight = _lanes(data, "<u8")
        owner = np.full(mask + 1, -1, np.int64)
        at = (key & np.uint64(mask)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            free = left[owner[at[left]] < 0]
            owner[at[free]] = free  # of several that find a slot free, the last has it
            holder = owner[at[left]]
            hit = (key[holder] == key[left]) & (spans.length[holder] == spans.length[left])
            i = np.flatnonzero(hit)
            hit[i] = _equal(data, eight, spans.start[holder[i]], spans.start[left[i]], spans.length[left[i]])
            left = left[~hit]
            at[left] = (at[left] + 1) & mask
        self.slot, self.size = at, mask + 1
        self.used = np.flatnonzero(owner >= 0)
        self.holder = owner[self.used]

    @functools.cached_property
    def count(self) -> np.ndarray:
        return np.bincount(self.slot, minlength=self.size)[self.used]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """For each occurrence the value of its string; values has one for each used slot."""
        out = np.zeros(self.size, values.dtype)
        out[self.used] = values
        return out[self.slot]
