"""Signature trees: which of some sets are linked by Jaccard similarity.

A leaf is a set with a bitmap of its hashed tokens. An inner node has the OR of the bitmaps below it and the range of
set sizes below it. Two trees (or one with itself) are walked together; a pair of nodes is left when no pair of sets
below could share enough tokens: shared tokens have common bits, and no more tokens share a bit in one set than its
size exceeds its bit count.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16


class Clusters:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    flat = np.zeros(bits, bool)
    flat[(tokens % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flat)


class Tree:
    """Levels of nodes, the sets first; node i of a level covers nodes FANOUT*i .. FANOUT*i + FANOUT - 1 below."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        self._grow(np.stack([bitmap(s, bits) for s in sets]).view(np.uint64), sizes)

    @classmethod
    def of_bitmaps(cls, maps: np.ndarray, sizes: np.ndarray) -> Tree:
        tree = cls.__new__(cls)
        tree._grow(maps, sizes)
        return tree

    def _grow(self, maps: np.ndarray, sizes: np.ndarray) -> None:
        spare = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, spare = self.levels[-1]
            cut = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut)))


def pairs_that_may_link(a: Tree, b: Tree, num: int, den: int):
    """Blocks (i, array of j) of leaves of a and b that no bound excludes; with a is b, only j > i. num/den is the least Jaccard similarity."""
    same = a is b
    depth = max(len(a.levels), len(b.levels)) - 1
    la, lb = min(depth, len(a.levels) - 1), min(depth, len(b.levels) - 1)
    stack = [(la, 0, lb, np.zeros(1, np.int64))]
    while stack:
        x, i, y, js = stack.pop()
        if same:
            js = js[js >= i] if x else js[js > i]
        maps, low, high, spare = a.levels[x]
        bmaps, blow, bhigh, bspare = b.levels[y]
        keep = (high[i] * den >= blow[js] * num) & (bhigh[js] * den >= low[i] * num)
        js = js[keep]
        if not len(js):
            continue
        shared = np.bitwise_count(maps[i] & bmaps[js]).sum(axis=1, dtype=np.int64) + np.minimum(spare[i], bspare[js])
        # I >= t * (|x| + |y| - I), so I * (num + den) >= num * (|x| + |y|)
        js = js[shared * (num + den) >= num * (low[i] + blow[js])]
        if not len(js):
            continue
        if x == 0 and y == 0:
            yield i, js
            continue
        below = js
        if y:
            below = (js[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = below[below < len(b.levels[y - 1][0])]
        for child in range(i * FANOUT, min((i + 1) * FANOUT, len(a.levels[x - 1][0]))) if x else [i]:
            stack.append((max(x - 1, 0), child, max(y - 1, 0), below))


def small_bits(size: int) -> int:
    """One and a half to three bits a token, as a power of two; fewer for very large sets. Enough to tell unlike sets apart."""
    return min(32_768, max(64, 1 << (3 * size // 2 - 1).bit_length()))


def may_link(sizes: list[int], bitmaps: list[bytes], num: int, den: int) -> np.ndarray:
    """For each set the first one of its cluster, where all pairs that no bound excludes, from sizes and bitmaps alone, are joined.

    Bitmaps may differ in length; all are folded to the shortest, since lengths are powers of two.
    """
    order = np.argsort(np.array(sizes), kind="stable")
    width = min(len(b) for b in bitmaps)
    maps = np.stack([np.bitwise_or.reduce(np.frombuffer(bitmaps[i], np.uint8).reshape(-1, width), axis=0) for i in order]).view(np.uint64)
    tree = Tree.of_bitmaps(maps, np.array(sizes, np.int64)[order])
    label = np.arange(len(sizes))
    for i, js in pairs_that_may_link(tree, tree, num, den):
        met = np.unique(np.append(label[order[js]], label[order[i]]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return label


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |x & y| >= num * |x | y|, for sorted distinct tokens."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(small) * den < num * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return both * den >= num * (len(x) + len(y) - both)


def bitmap_bits(sets: list[np.ndarray]) -> int:
    """About four bits a token; fewer for very large sets, where the bounds are weaker but still hold."""
    return min(16_384, max(64, 1 << (4 * max(len(s) for s in sets) - 1).bit_length()))


def link(sets: list[np.ndarray], num: int, den: int, split: int | None = None) -> Clusters:
    """Clusters of the sets that chains of links join.

    With split, the sets before it are compared only with those from it on. Pairs that are in one cluster already are
    not compared again.
    """
    found = Clusters(len(sets))
    if len(sets) < 2:
        return found
    bits = bitmap_bits(sets)
    order = sorted(range(len(sets)), key=lambda i: (split is not None and i >= split, len(sets[i])))
    if split is None:
        a = b = Tree([sets[i] for i in order], bits)
        right = order
    else:
        a, b = Tree([sets[i] for i in order[:split]], bits), Tree([sets[i] for i in order[split:]], bits)
        right = order[split:]
    for i, js in pairs_that_may_link(a, b, num, den):
        u = order[i]
        for j in js:
            v = right[j]
            if found.root(u) != found.root(v) and linked(sets[u], sets[v], num, den):
                found.join(u, v)
    return found
