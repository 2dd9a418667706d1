"""Words of many texts at once as numpy arrays, for operators on word windows and shingles.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. All work is on the bytes of an Arrow column; no
Python string is made.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is taken alone.
CHUNK_BYTES = 256 << 10
#: Bytes whose words are hashed at a time, and the longest word that takes part in that; a longer one is hashed alone.
HASH_BYTES = 128 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACES = bytes(0x20 if x else i for i, x in enumerate(_SPACE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base, and of its inverse, that HASH_BYTES bytes need."""
    steps = [np.full(HASH_BYTES + 1, x, np.uint64) for x in (_BASE, _BASE_INV)]
    for x in steps:
        x[0] = 1
    return tuple(np.cumprod(x, dtype=np.uint64) for x in steps)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, wherever it stands."""
    out = np.empty(len(start), np.uint64)
    power, inverse = _powers()
    at = 0
    while at < len(start):
        begin = int(start[at])
        to = int(np.searchsorted(end, begin + HASH_BYTES, "right"))
        if to <= at:
            out[at] = int.from_bytes(hashlib.blake2b(data[begin:end[at]].tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        part = data[begin:end[to - 1]]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:len(part)], out=prefix[1:])
        out[at:to] = (prefix[end[at:to] - begin] - prefix[start[at:to] - begin]) * inverse[start[at:to] - begin]
        at = to
    return mix(out)


class Words:
    """The words of len(first) - 1 texts: word j is data[start[j]:end[j]], text i has words first[i] to first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edge[:n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edge[1:]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = _hashes(data, self.start, self.end)

    def grams(self, n: int) -> np.ndarray:
        """A 64-bit hash of the n words from each word on; those that run over a text's end mean nothing."""
        count = max(0, len(self.hash) - n + 1)
        out = np.full(count, np.uint64(n), np.uint64)
        for i in range(n):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + self.hash[i:i + count])
        return out

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts with one space for every gap between two words, and where each word starts and ends in that."""
        keep = ~_SPACE[self.data]
        follows = ~np.append(keep, True)[self.end]  # where a text ends in a word, the next one's may follow at once
        keep[self.end[follows]] = True
        data = self.data if keep.all() else self.data[keep]
        size = self.end - self.start
        end = np.cumsum(size + follows)
        begin = end - size - follows
        return data.tobytes().translate(_SPACES), begin, begin + size


def chunks(texts: pa.Array, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """(number of the first text, Words) over consecutive texts of about `most` bytes; null is an empty text."""
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
        yield at, Words(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], lower)
        at = to


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-word shingles; a shorter text is one shingle, an empty one none."""
    grams = words.grams(n)
    for i in range(len(words.first) - 1):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            whole = np.full(1, np.uint64(b - a), np.uint64)
            for h in words.hash[a:b]:
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + h)
            yield whole
        else:
            yield np.zeros(0, np.uint64)
