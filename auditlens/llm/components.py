"""Connected components of an edge table, by alternating stars: rounds of joins and minima, no list of neighbours anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import cut

ROUNDS = 60
HELD = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) for every id of the edges that is not the smallest itself."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars, some hundred thousand at a time."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > HELD:
            a, b = stars(a, b)
            if len(a) > HELD // 2:
                yield edge_batch(a, b)
                a, b = a[:0], b[:0]
    yield edge_batch(*stars(a, b))


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in edges (a, b), component being the smallest id that is reachable.

    Edges are first drawn together to stars within each task. Each round then hangs the larger neighbours of every id on the smallest of them, then the smaller ones, until nothing changes; a
    chain halves with every round. Rounds are kept in the shared folder. An edge of an id with itself, or with a NULL, is none.
    """
    drawn = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "a long, b long")
    now = cut(drawn.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().select("u", "v")
              .withColumnsRenamed({"u": "a", "v": "b"}).mapInArrow(_contract, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")))
    if now.limit(1).count() == 0:
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    state = _state(now)
    for _ in range(ROUNDS):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        now = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    """A digest of the edges; equal twice means that a round changed nothing."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))).first())
