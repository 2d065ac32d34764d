"""Greedy string tiling of two token sequences by running Karp-Rabin hashes."""

from __future__ import annotations

import numpy as np

from auditlens.llm.vectors import BASE, INVERSE, mix, powers


class _Side:
    def __init__(self, tokens: np.ndarray) -> None:
        n = len(tokens)
        self.n, self.marked = n, np.zeros(n, bool)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens) * powers(BASE, n))])
        self.shift = powers(INVERSE, n + 1)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of all stretches of `size` tokens without a marked one."""
        if size > self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return at, (self.sums[at + size] - self.sums[at]) * self.shift[at]

    def free(self, at: int, size: int) -> bool:
        return not self.marked[at:at + size].any()


def _longest(a: _Side, b: _Side, least: int, most: int) -> int:
    """Length of the longest common stretch of unmarked tokens, 0 below `least`; a shorter one is common if a longer one is."""
    low, high = least - 1, most
    while low < high:
        size = (low + high + 1) // 2
        if len(np.intersect1d(a.windows(size)[1], b.windows(size)[1])):
            low = size
        else:
            high = size - 1
    return low if low >= least else 0


def tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in pattern, start in text, length) of the tiles, longest first; each token of either side is in one tile at most.

    Of equally long matches the leftmost of the text goes first, with the leftmost free one of the pattern.
    """
    a, b, out = _Side(pattern), _Side(text), []
    size = min(a.n, b.n)
    while size := _longest(a, b, least, size):
        at_a, hash_a = a.windows(size)
        at_b, hash_b = b.windows(size)
        order = np.lexsort((at_a, hash_a))
        at_a, hash_a = at_a[order], hash_a[order]
        first, last = np.searchsorted(hash_a, hash_b), np.searchsorted(hash_a, hash_b, "right")
        used = dict[int, int]()
        for k in np.flatnonzero(last > first).tolist():
            start = int(at_b[k])
            if not b.free(start, size):
                continue
            at = used.get(int(first[k]), int(first[k]))
            while at < last[k] and not a.free(int(at_a[at]), size):
                at += 1
            used[int(first[k])] = at
            if at < last[k]:
                begin = int(at_a[at])
                a.marked[begin:begin + size] = b.marked[start:start + size] = True
                out.append((begin, start, size))
    return out
