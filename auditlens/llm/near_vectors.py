"""Near duplicates among embeddings by lattice hashing: cells of E8 in several tables, neighbouring cells probed, cosines verified.

1. Rows with the same vector are one class, counted before anything else moves. Vectors that are NULL, zero, or hold a NULL or a
   number that is not finite are in no class and link with nothing.
2. Every class gives the hashes of its own cell and of the cells it looks into, table by table. Cells that no second class meets go
   at once. The others get the vectors; a cell of many rows is cut into blocks, and each pair of blocks is a task's work.
3. A task takes the cosines of rows that meet where one of them is at home, in double precision. A pair that meets more than once
   counts in the first table only, and there in the home cell of the smaller id. Only sums per class and links that connect what is
   not yet connected leave the task: pairs are never listed.

Cells shrink as rows grow, so that a cell holds as many unrelated rows at every size, and the number of tables grows to hold the
chance of a pair of exactly the least cosine to meet; nearer pairs meet more surely. How many links a class has can only be told by
looking at each of them once, so a group of n different vectors that are all near each other costs n * n / 2 cosines, dealt in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import cut, one_per_id
from auditlens.llm.components import components, stars
from auditlens.llm.lattice import Tables

COSINE = 0.9
#: Chance that a pair of exactly the least cosine meets.
RECALL = 0.995
#: Rows of a block of a cell, and the size up to which all cells of a batch are taken together.
BLOCK, SMALL = 2048, 32
#: Vectors hashed, and pairs checked for an earlier meeting, at a time.
ROWS, PAIRS = 4096, 50_000
NO_ID = (1 << 63) - 1


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest entry first, so that no square overflows."""
    held = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return held / np.sqrt((held * held).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


class _Meetings:
    """Verified pairs of the cells of one batch, each in the one place where it counts."""

    def __init__(self, tables: Tables, key: np.ndarray, ids: np.ndarray, home: np.ndarray, unit: np.ndarray, cosine: float):
        self.tables, self.key, self.ids, self.home, self.unit, self.cosine = tables, key, ids, home, unit, cosine
        self.cells: np.ndarray | None = None
        self.place = np.zeros(len(ids), np.int64)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = (self.home[i] | self.home[j]) & (self.ids[i] != self.ids[j])
        i, j = i[held], j[held]
        keep = [np.einsum("ij,ij->i", self.unit[i[a:a + PAIRS]], self.unit[j[a:a + PAIRS]]) >= self.cosine for a in range(0, len(i), PAIRS)]
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return i[keep], j[keep]

    def hash_rows(self, rows: np.ndarray) -> None:
        """Cells of the rows that have links, once a distinct id."""
        distinct, first, at = np.unique(self.ids[rows], return_index=True, return_inverse=True)
        parts = [self.tables.cells(self.unit[rows[first[a:a + ROWS]]]) for a in range(0, len(first), ROWS)]
        self.cells = np.concatenate(parts) if parts else np.zeros((0, self.tables.count, 1), np.uint64)
        self.place[rows] = at

    def counted(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether this cell is where the pair counts: the first table in which one looks into the other's home, and there the
        shared home, or the home of the smaller id if the larger one looks there, or else that of the larger."""
        out = np.zeros(len(i), bool)
        for a in range(0, len(i), PAIRS):
            p, q = i[a:a + PAIRS], j[a:a + PAIRS]
            swap = self.ids[p] > self.ids[q]
            small, large = self.cells[self.place[np.where(swap, q, p)]], self.cells[self.place[np.where(swap, p, q)]]
            at_small = (large == small[:, :, :1]).any(2)
            at_large = (small == large[:, :, :1]).any(2)
            first = (at_small | at_large).argmax(1)
            each = np.arange(len(p))
            spot = np.where(at_small[each, first], small[each, first, 0], large[each, first, 0])
            out[a:a + PAIRS] = spot.view(np.int64) == self.key[p]
        return out


def _pairs(begin: np.ndarray, total: int, side: np.ndarray, alone: np.ndarray, home: np.ndarray, unit: np.ndarray,
           cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) that meet: all of a small run at once by their distance, near ones of a large run by matrix products."""
    size = np.diff(np.append(begin, total))
    place = np.arange(total) - np.repeat(begin, size)
    of = np.repeat(size, size)
    small = of <= SMALL
    for step in range(1, SMALL):
        i = np.flatnonzero(small & (place + step < of))
        if not len(i):
            break
        j = i + step
        met = alone[i] | (side[i] != side[j])
        yield i[met], j[met]
    for low, count in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist()):
        rows = np.arange(low, low + count)
        left, right = (rows, rows) if alone[low] else (rows[side[rows] == 0], rows[side[rows] == 1])
        for a in range(0, len(left), 512):
            some = left[a:a + 512]
            close = unit[some] @ unit[right].T >= cosine - 1e-9
            close &= home[some][:, None] | home[right][None, :]
            if alone[low]:
                close &= right[None, :] > some[:, None]
            x, y = np.nonzero(close)
            yield some[x], right[y]


def _meet(tables: Tables, dims: int, cosine: float):
    """From rows sorted by (cell, bi, bj): (a, b, NULL) for links that connect, and (a, NULL, n) for the rows linked with class a."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _runs(batches):
            ids, key = table.column("id").to_numpy(), table.column("cell").to_numpy()
            copies, home = table.column("copies").to_numpy(), table.column("home").to_numpy().astype(bool)
            alone = table.column("bi").to_numpy() == table.column("bj").to_numpy()
            column = table.column("v").combine_chunks()
            unit = unit_rows(_matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, dims))
            state = _Meetings(tables, key, ids, home, unit, cosine)
            total, edges = np.zeros(len(ids), np.int64), []
            found = [p for p in (state.near(*q) for q in _pairs(begin, len(ids), table.column("side").to_numpy(), alone, home, unit, cosine)) if len(p[0])]
            if not found:
                continue
            state.hash_rows(np.unique(np.concatenate([x for p in found for x in p])))
            for i, j in found:
                there = state.counted(i, j)
                i, j = i[there], j[there]
                np.add.at(total, i, copies[j])
                np.add.at(total, j, copies[i])
                edges.append(stars(ids[i], ids[j]))
            a, b = stars(*(np.concatenate(c) for c in zip(*edges)))
            linked, at = np.unique(ids[total > 0], return_inverse=True)
            sums = np.zeros(len(linked), np.int64)
            np.add.at(sums, at, total[total > 0])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([a, linked])), pa.array(np.concatenate([b, linked]), mask=np.arange(len(a) + len(linked)) >= len(a)),
                pa.array(np.concatenate([np.zeros(len(a), np.int64), sums]))], ["a", "b", "n"])
    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where runs begin) of batches sorted by (cell, bi, bj); a run is never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            table, begin = _table(held)
            if len(begin) > 1:
                yield table.slice(0, begin[-1]), begin[:-1]
                held = table.slice(begin[-1]).to_batches()
    if held:
        yield _table(held)


def _table(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    new = np.ones(table.num_rows, bool)
    keys = [table.column(k).to_numpy() for k in ("cell", "bi", "bj")]
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return table, np.flatnonzero(new)


def _links(classes: DataFrame, dims: int, rows: int, cosine: float, recall: float) -> DataFrame:
    """(a, b, n) of classes (id, copies, v) of one number of dimensions."""
    tables = Tables(dims, rows, cosine, recall)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                cells = tables.cells(unit_rows(_matrix(batch.column("v"), dims)))
                per = cells.shape[1] * cells.shape[2]
                home = np.zeros(cells.shape, np.int8)
                home[:, :, 0] = 1
                yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), per)),
                                                  pa.array(home.reshape(-1))], ["cell", "id", "home"])

    looked = classes.select("id", "v").mapInArrow(hashes, "cell long, id long, home byte")
    met = (looked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("home").alias("homes"))
           .where("n > 1 and homes > 0").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (looked.join(met, "cell").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cell", "id", "home", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
                     F.when(F.col("own") == F.greatest("own", "other"), 1).otherwise(0).cast("byte").alias("side")))
    full = dealt.join(classes, "id").repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj")
    return full.select("cell", "bi", "bj", "side", "id", "home", "copies", "v").mapInArrow(
        _meet(tables, dims, cosine), "a long, b long, n long")


def vector_components(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", cosine: float = COSINE,
                      recall: float = RECALL) -> DataFrame:
    """Rows (vec_id, class_id, n_links, component_id, kept): smallest id of the same vector, other vectors of a cosine of `cosine` or
    more, smallest id that links reach, and whether that is the row's own.

    Vectors that are NULL, empty, zero, or hold NULL or a number that is not finite link with nothing; so do those of different
    lengths with each other. Rows that repeat an id are one vector, the largest. NULL is an id, larger than all others. Further
    columns are not looked at. An empty table gives no rows.
    """
    whole = one_per_id(vectors.select(F.col(key).cast("long").alias("id"), F.col(value).alias("v")), "id", "v")
    sound = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    sound &= F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    rows = whole.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.when(sound, F.col("v")).alias("v"))
    one = rows.where(F.col("v").isNotNull()).withColumn("v", F.transform("v", lambda c: F.when(c == 0, F.lit(0).cast("double")).otherwise(c.cast("double"))))
    classes = cut(one.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "copies", "v"))
    found = None
    for size in classes.groupBy(F.size("v").alias("dims")).count().collect():
        part = _links(classes.where(F.size("v") == size.dims), size.dims, size["count"], cosine, recall)
        found = part if found is None else found.unionByName(part)
    members = cut(rows.join(one.join(classes.select(F.col("id").alias("rep"), "copies", "v"), "v").select("id", "rep", "copies"), "id", "left")
                  .select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")))
    if found is None:
        linked = members.select("rep", F.col("rep").alias("smallest"), F.lit(0).cast("long").alias("n")).limit(0)
    else:
        found = cut(found)
        counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        near = components(found.where("b is not null").select("a", "b")).withColumnsRenamed({"id": "rep", "component": "smallest"})
        linked = counts.join(near, "rep")
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (members.join(linked, "rep", "left").withColumn("smallest", F.coalesce("smallest", "rep"))
            .select(named("id").alias("vec_id"), named("rep").alias("class_id"),
                    (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
                    named("smallest").alias("component_id"), (F.col("id") == F.col("smallest")).alias("kept")))
