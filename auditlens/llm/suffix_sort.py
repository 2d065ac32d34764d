"""Suffixes of one bucket: multikey quicksort, common prefixes, and which windows occur earlier."""

from __future__ import annotations

import hashlib

import numpy as np

from auditlens.llm.vectors import mix

SMALL = 48


def multikey_order(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of rows of 8-byte keys, by columns from the left, equal ones by length.

    Three-way partitions around a middle key: smaller and larger rows go on with the same column, equal ones with the next.
    """
    order = np.arange(len(keys))
    stack = [(0, len(keys), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        rows = order[low:high]
        if high - low <= SMALL or depth == keys.shape[1]:
            order[low:high] = rows[np.lexsort((lengths[rows], *(keys[rows, c] for c in range(keys.shape[1] - 1, depth - 1, -1))))]
            continue
        key = keys[rows, depth]
        pivot = np.partition(key[::max(1, len(key) // 31)], len(key[::max(1, len(key) // 31)]) // 2)[len(key[::max(1, len(key) // 31)]) // 2]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[low:high] = np.concatenate([rows[less], rows[same], rows[more]])
        a, b = low + int(less.sum()), high - int(more.sum())
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def common_prefixes(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row with the one before (0 for the first)."""
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))])


class Bucket:
    """Windows of `width` bytes round anchors: `right` from the anchor on, `left` before it in reverse, order by (rid, anchor).

    Windows in the first and last run of suffixes may have equals in other buckets, those between have not."""

    def __init__(self, right: list[bytes], left: list[bytes], rid: np.ndarray, anchor: np.ndarray, width: int) -> None:
        pad = -(-max(map(len, right)) // 8) * 8
        rows = np.frombuffer(b"".join(r.ljust(pad, b"\0") for r in right), np.uint8).reshape(-1, pad)
        lengths = np.array([len(r) for r in right])
        order = multikey_order(rows.view(">u8").astype(np.uint64), lengths)
        self.width, self.right, self.left = width, [right[k] for k in order], [left[k] for k in order]
        self.rid, self.anchor, self.size = rid[order], anchor[order], lengths[order]
        self.before = np.array([len(s) for s in self.left])
        self.common = common_prefixes(rows[order], self.size)
        by_place = np.lexsort((self.anchor, self.rid))
        most = max(1, int(self.before.max()))
        back = np.frombuffer(b"".join(s.ljust(most, b"\0") for s in self.left), np.uint8).reshape(-1, most)
        self.repeated = np.zeros((len(order), width), bool)
        self.open: list[tuple[int, int]] = []
        hashes = np.zeros(len(order), np.uint64)
        for o in range(min(width, int(self.before.max()) + 1)):
            if o:
                hashes = (hashes ^ (back[:, o - 1].astype(np.uint64) + np.uint64(1))) * np.uint64(0x100000001B3)
                hashes ^= hashes >> np.uint64(29)
            self._offset(o, by_place, hashes)

    def _offset(self, o: int, by_place: np.ndarray, hashes: np.ndarray) -> None:
        """Windows that begin o bytes before their anchor: equal ones share o bytes to the left and the rest to the right."""
        rest = self.width - o
        run = np.cumsum(self.common < rest)
        valid = by_place[((self.before >= o) & (self.size >= rest))[by_place]]
        if not len(valid):
            return
        key = mix(hashes[valid] ^ mix(run[valid].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = key[order[1:]] == key[order[:-1]]
        self.repeated[valid[order[same]], o] = True
        edge = valid[order[~same]]
        edge = edge[(run[edge] == run[0]) | (run[edge] == run[-1])]
        self.open += [(int(k), o) for k in edge]

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rid, first start, last start) of the windows that occur earlier in this bucket."""
        flags = np.zeros((len(self.rid), self.width + 2), np.int8)
        flags[:, 1:-1] = self.repeated
        step = np.diff(flags, axis=1)
        row, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)
        return self.rid[row], self.anchor[row] - high + 1, self.anchor[row] - low

    def edges(self) -> list[tuple[int, int, int, int]]:
        """(two halves of a digest of the window, rid, start) of the first windows of classes that may go on in another bucket."""
        out = []
        for k, o in self.open:
            window = self.left[k][:o][::-1] + self.right[k][:self.width - o]
            d = hashlib.blake2b(window, digest_size=16, salt=o.to_bytes(4, "big")).digest()
            out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), int(self.rid[k]), int(self.anchor[k] - o)))
        return out
