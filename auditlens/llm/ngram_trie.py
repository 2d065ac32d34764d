"""Sets of n-grams in a trie: all partners of a set found in one walk that shares the overlap of common beginnings."""

from __future__ import annotations

import numpy as np


#: Cells of the table that probes walking together share.
PROBE_CELLS = 1_000_000
RANKS_AT_ONCE = 400_000


def least_common(n, m, percent: int):
    """Smallest intersection with which sets of n and m reach a Jaccard similarity of percent / 100."""
    return -(-(n + m) * percent // (100 + percent))


class Links:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.parts = n

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.parts -= 1
        return True


class Trie:
    """Sets given as rising arrays of ranks (rank 0 first). Nodes hold runs of ranks that their sets share."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        texts = [s.astype(">u4").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=texts.__getitem__), np.int64)
        sizes = [len(sets[k]) for k in self.order]
        # nodes: parent, run in `ranks`, depth after the run, smallest and largest set below, sets that end here
        self.parent, self.depth, self.low, self.high = [-1], [0], [0], [0]
        runs: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.ends: list[list[int]] = [[]]
        self.begin, self.end = [0], [len(sets)]
        path = [0]
        before: np.ndarray | None = None
        for place, (k, size) in enumerate(zip(self.order.tolist(), sizes)):
            s = sets[k]
            shared = 0
            if before is not None:
                n = min(len(before), len(s))
                differ = np.flatnonzero(before[:n] != s[:n])
                shared = int(differ[0]) if len(differ) else n
            while self.depth[path[-1]] > shared:
                node = path.pop()
                self.end[node] = place
                if self.depth[path[-1]] < shared:
                    cut = shared - self.depth[path[-1]]
                    upper = self._add(path[-1], runs, runs[node][:cut], shared)
                    runs[node] = runs[node][cut:]
                    self.parent[node] = upper
                    self.begin[upper] = self.begin[node]
                    path.append(upper)
            if size > shared:
                path.append(self._add(path[-1], runs, s[shared:], size))
                self.begin[path[-1]] = place
            self.ends[path[-1]].append(k)
            before = s
        self._seal(runs, [len(s) for s in sets])

    def _add(self, parent: int, runs: list[np.ndarray], run: np.ndarray, depth: int) -> int:
        self.parent.append(parent)
        self.depth.append(depth)
        self.ends.append([])
        self.begin.append(0)
        self.end.append(len(self.order))
        runs.append(run)
        return len(runs) - 1

    def _seal(self, runs: list[np.ndarray], sizes: list[int]) -> None:
        n = len(runs)
        low, high = np.full(n, 1 << 40), np.zeros(n, np.int64)
        for node in sorted(range(n), key=lambda k: -self.depth[k]):
            for k in self.ends[node]:
                low[node], high[node] = min(low[node], sizes[k]), max(high[node], sizes[k])
            up = self.parent[node]
            if up >= 0:
                low[up], high[up] = min(low[up], low[node]), max(high[up], high[node])
        self.low, self.high = low, high
        lengths = np.array([len(r) for r in runs])
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.ranks = np.concatenate(runs) if n else np.zeros(0, np.int64)
        self.last = np.where(lengths > 0, self.ranks[np.maximum(self.at[1:] - 1, 0)] if len(self.ranks) else 0, -1)
        self.depth_of = np.array(self.depth)
        up = np.array(self.parent)
        self.below = np.argsort(up, kind="stable")
        self.first = np.searchsorted(up[self.below], np.arange(n))
        self.until = np.searchsorted(up[self.below], np.arange(n), "right")
        self.is_end = np.array([bool(e) for e in self.ends])
        self.bounds = np.stack([self.begin, self.end], axis=1).ravel()
        self.alike = np.full(n, -1)

    def connected(self, roots: np.ndarray) -> None:
        """Take note which subtrees hold sets of a single component: a probe of that component need not enter them."""
        by_leaf = np.append(roots[self.order], 0)
        low = np.minimum.reduceat(by_leaf, self.bounds)[::2]
        high = np.maximum.reduceat(by_leaf, self.bounds)[::2]
        self.alike = np.where(low == high, low, -1)

    def partners(self, probes: list[np.ndarray], width: int, percent: int, roots: np.ndarray) -> list[tuple[int, int]]:
        """(probe, position) of all sets of other components that reach the similarity with a probe; `width` ranks in all.

        The probes walk down together, level by level, each with its own subtrees. A subtree is left when even its best
        length cannot make up for what is missing: neither the ranks that remain of the probe nor those that remain of its
        sets suffice.
        """
        marks = np.zeros((len(probes), width + 1), np.int32)
        for b, probe in enumerate(probes):
            marks[b, probe + 1] = 1
        upto = np.cumsum(marks, axis=1, dtype=np.int32)
        sizes = np.array([len(p) for p in probes])
        out: list[tuple[int, int]] = []
        by, nodes, got = np.arange(len(probes)), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64)
        while len(nodes):
            for k in np.flatnonzero(self.is_end[nodes] & (got >= least_common(sizes[by], self.depth_of[nodes], percent))):
                out += [(int(by[k]), j) for j in self.ends[nodes[k]]]
            counts = self.until[nodes] - self.first[nodes]
            total = int(counts.sum())
            child = self.below[np.repeat(self.first[nodes] - (np.cumsum(counts) - counts), counts) + np.arange(total)]
            by, got = np.repeat(by, counts), np.repeat(got, counts)
            n, low, high, depth = sizes[by], self.low[child], self.high[child], self.depth_of[child]
            new = (self.alike[child] != roots[by]) & (100 * high >= percent * n) & (100 * n >= percent * low)
            by, child, got = by[new], child[new], got[new]
            if not len(child):
                break
            n, low, high, depth = n[new], low[new], high[new], depth[new]
            size = self.at[child + 1] - self.at[child]
            total = np.cumsum(size)
            more, low_at = np.zeros(len(child), np.int64), 0
            while low_at < len(child):  # so many ranks at a time
                high_at = max(low_at + 1, int(np.searchsorted(total, total[low_at] - size[low_at] + RANKS_AT_ONCE, "right")))
                own = size[low_at:high_at]
                starts = np.cumsum(own) - own
                at = np.repeat(self.at[child[low_at:high_at]] - starts, own) + np.arange(int(own.sum()))
                more[low_at:high_at] = np.add.reduceat(marks[np.repeat(by[low_at:high_at], own), self.ranks[at] + 1], starts)
                low_at = high_at
            got = got + more
            left = n - upto[by, self.last[child] + 1]
            alive = (got + left >= least_common(n, low, percent)) & (got + high - depth >= least_common(n, high, percent))
            by, nodes, got = by[alive], child[alive], got[alive]
        return out


def spanning_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever is linked among `left` (or between left and right), no more than sets less one.

    Positions count through left, then right. Sets are arrays of distinct grams. Ranks follow how many of the sets hold a
    gram, the most frequent first, so that like sets share long beginnings. Probing ends when all that is left to probe is
    connected already.
    """
    sets = left + (right or [])
    grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(grams))
    ranked = [np.sort(r) for r in np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])]
    trie = Trie(ranked[:len(left)])
    links, out = Links(len(sets)), []
    probes = list(range(len(left), len(sets)) if right is not None else range(len(left)))
    batch = max(1, min(64, PROBE_CELLS // (len(grams) + 1)))
    for at in range(0, len(probes), batch):
        part = probes[at:at + batch]
        roots = np.array([links.root(j) for j in range(len(sets))])
        if links.parts == 1 or right is None and len(set(roots[probes[at]:].tolist())) == 1:
            break
        trie.connected(roots[:len(left)])
        found = trie.partners([ranked[k] for k in part], len(grams), percent, np.where(at, roots[part], -2))
        out += [(part[b], j) for b, j in found if j != part[b] and links.join(part[b], j)]
    return out
