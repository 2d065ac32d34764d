"""Points of the lattice E8, and tables that hash directions to its cells.

E8 is the densest way of packing balls in eight dimensions, so its cells are rounder than those of a grid, and a point has only the
240 shortest vectors of the lattice as neighbouring cells. A table projects a vector to two blocks of eight dimensions, moves it by an
offset, and takes the nearest lattice point of each block; the pair of points is its cell.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np

from auditlens.llm.vectors import mix

BLOCKS = 2
#: Cells a vector looks into, in each table, its own included.
PROBES = 8
#: How far unit vectors of SCALE_DIMS dimensions are drawn out against a cell when there are SCALE_ROWS of them. With more rows cells
#: shrink, so that one holds as many unrelated rows; with other dimensions, near vectors stay as near in the eight that are left.
SCALE, SCALE_ROWS, SCALE_DIMS = 4.0, 50_000, 64
#: Pairs simulated to choose probes and the number of tables.
SIMULATED = 4_000
SEED = 811


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: all rounded, and where the sum is odd the least certain one the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(-1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(-1)
    near[odd, worst] += np.where(off[odd, worst] < 0, -1.0, 1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which are the even whole points and those moved by a half in all eight dimensions."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1))[:, None], whole, half)


@cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors but zero: two entries of 1 or -1, or eight halves with an even number of minus signs."""
    out = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0]
    return np.array(out)


class Tables:
    """Hash tables for vectors of `dims` dimensions among about `rows` rows: a pair of the given cosine shares a cell of one of them,
    its own for one side and one of the probed for the other, with a chance of `recall`.

    Probes are ranks of neighbouring cells, nearest first, one rank a block (0 is the own cell). Which ranks pay, and how many tables
    are needed, comes from simulated pairs; everything is drawn from a fixed seed, so all tasks have the same tables.
    """

    def __init__(self, dims: int, rows: int, cosine: float, recall: float, probes: int = PROBES):
        self.dims = dims
        self.scale = SCALE * (max(rows, 1) / SCALE_ROWS) ** (1 / (8 * BLOCKS)) * (dims / SCALE_DIMS) ** 0.5
        rng = np.random.default_rng([SEED, dims])
        a = rng.normal(size=(SIMULATED, dims))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=(SIMULATED, dims))
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        b = cosine * a + np.sqrt(1 - cosine * cosine) * b
        self.projections, self.offsets = self._draw(rng, 1)
        (own, near), (other, back) = (self._blocks(v, len(shortest()))[0] for v in (a, b))
        there, here = self._rank(own, near, other), self._rank(other, back, own)
        seen, count = np.unique(there[(there >= 0).all(1)], axis=0, return_counts=True)
        best = np.lexsort((*seen.T[::-1], -count))
        self.probes = seen[best[:probes]].astype(np.int64)
        at_home = (self.probes == 0).all(1)
        if not at_home.any():
            self.probes = np.concatenate([np.zeros((1, BLOCKS), np.int64), self.probes])[:probes]
        self.probes = self.probes[np.argsort(~(self.probes == 0).all(1), kind="stable")]
        hit = np.zeros(SIMULATED, bool)
        for ranks in self.probes:
            hit |= (there == ranks).all(1) | (here == ranks).all(1)
        miss = 1 - max(hit.mean(), 1 / SIMULATED)
        self.count = 1 if miss == 0 else max(1, int(np.ceil(np.log(1 - recall) / np.log(miss))))
        self.projections, self.offsets = self._draw(rng, self.count)

    def _draw(self, rng: np.random.Generator, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Projections with orthonormal columns where the dimensions allow it, each with an offset."""
        wide = 8 * BLOCKS
        drawn = [rng.normal(size=(self.dims, wide)) for _ in range(count)]
        drawn = [np.linalg.qr(d)[0] if self.dims >= wide else d / np.sqrt(max(self.dims, 1)) for d in drawn]
        return np.array(drawn) * self.scale, rng.uniform(0, 1, (count, wide))

    def _blocks(self, unit: np.ndarray, ranks: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every table (cells, steps): cells (row, block, 8) doubled to whole numbers, and the `ranks` nearest steps to a
        neighbouring cell (row, block, rank), as places in `shortest`."""
        out = []
        for project, offset in zip(self.projections, self.offsets):
            x = (unit @ project + offset).reshape(-1, 8)
            home = nearest(x)
            nearness = (x - home) @ shortest().T
            if ranks < nearness.shape[1]:
                some = np.argpartition(-nearness, ranks, axis=1)[:, :ranks]
            else:
                some = np.broadcast_to(np.arange(nearness.shape[1]), nearness.shape)
            order = np.argsort(-np.take_along_axis(nearness, some, 1), axis=1, kind="stable")
            steps = np.take_along_axis(some, order, 1)
            out.append(((2 * home).astype(np.int64).reshape(len(unit), BLOCKS, 8), steps.reshape(len(unit), BLOCKS, -1)))
        return out

    @staticmethod
    def _rank(own: np.ndarray, steps: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Rank of the cell `other` among the neighbours of `own`, by block; -1 where it is none."""
        step = (2 * shortest()).astype(np.int64)[steps]
        same = (own[:, :, None, :] + step == other[:, :, None, :]).all(-1)
        rank = np.where(same.any(-1), same.argmax(-1) + 1, -1)
        return np.where((own == other).all(-1), 0, rank)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(row, table, probe) hashes of the cells that unit vectors look into, the own cell first."""
        out = np.zeros((len(unit), self.count, len(self.probes)), np.uint64)
        step = (2 * shortest()).astype(np.int64)
        most = max(1, int(self.probes.max()))
        for t, (home, steps) in enumerate(self._blocks(unit, most)):
            for p, ranks in enumerate(self.probes):
                held = np.full(len(unit), np.uint64(t + 1))
                for k, rank in enumerate(ranks):
                    cell = home[:, k] + step[steps[:, k, rank - 1]] if rank else home[:, k]
                    for d in range(8):
                        held = mix(held * np.uint64(0xD6E8FEB86659FD93) + cell[:, d].view(np.uint64))
                out[:, t, p] = held
        return out
