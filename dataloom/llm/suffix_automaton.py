"""A suffix automaton over word sequences that knows in which document each of its substrings occurs first."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """Of several sequences, each with an order number (its document); memory grows with their words.

    A state stands for the substrings that end at the same places; the longest has size[s] words, and those from
    size[suffix[s]] + 1 words on belong to it. least[s] is the smallest order number of a sequence that has them.
    """

    def __init__(self, sequences: Iterable[tuple[Sequence[Hashable], int]]):
        self.go: list[dict] = [{}]
        self.suffix, self.size, self.least = [-1], [0], [1 << 63]
        go, suffix, size, least = self.go, self.suffix, self.size, self.least
        for words, order in sequences:
            at = 0
            for w in words:
                q = go[at].get(w)
                if q is not None:  # another sequence has this beginning already
                    at = q if size[q] == size[at] + 1 else self._clone(at, w, q)
                    if order < least[at]:
                        least[at] = order
                    continue
                new, p = len(size), at
                go.append({})
                size.append(size[at] + 1)
                least.append(order)
                while p >= 0:
                    q = go[p].setdefault(w, new)
                    if q != new:
                        break
                    p = suffix[p]
                suffix.append(0)
                if p >= 0:
                    suffix[new] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
                at = new
        # Whatever ends where a longer substring ends occurs where that one does.
        for s in np.argsort(size, kind="stable")[:0:-1].tolist():
            up = suffix[s]
            if least[s] < least[up]:
                least[up] = least[s]

    def _clone(self, p: int, w: Hashable, q: int) -> int:
        """A state for the substrings that end in w after those of p, split off from q."""
        go, suffix, c = self.go, self.suffix, len(self.size)
        go.append(go[q].copy())
        suffix.append(suffix[q])
        self.size.append(self.size[p] + 1)
        self.least.append(1 << 63)
        suffix[q] = c
        while p >= 0 and go[p].get(w) == q:
            go[p][w] = c
            p = suffix[p]
        return c

    def statistics(self, words: Sequence[Hashable], most: int) -> Iterable[tuple[int, int]]:
        """For each word the length, up to most, of the longest substring ending there that occurs in a sequence, and
        the smallest order number of such a sequence (meaningless at length 0)."""
        go, suffix, size, least = self.go, self.suffix, self.size, self.least
        lengths, firsts = [], []
        at = length = 0
        for w in words:
            to = go[at].get(w)
            while to is None and at:
                at = suffix[at]
                length = size[at]
                to = go[at].get(w)
            if to is not None:
                at = to
                length += 1
                if length > most:  # drop the words before the last `most`
                    length = most
                    while size[suffix[at]] >= most:
                        at = suffix[at]
            lengths.append(length)
            firsts.append(least[at])
        return zip(lengths, firsts)
