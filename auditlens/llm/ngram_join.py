"""Jaccard similarity join of n-gram sets, exact, as classes of equal sets and the components of their links.

1. Every text becomes a set of n-gram hashes, a digest of the set, and a sketch: grams counted in a few cells by hash. Texts of
   equal sets are one class from here on, so that exact copies, however many, cost one set.
2. Grams have one global order: those that a count over the whole corpus (a fixed table of cells, summed by Spark) shows to be
   frequent come last, the rest by hash. Sets that reach the similarity share a gram among the first few of both (prefix filter),
   so classes meet in the buckets of these grams. There the length bound and the distance of the sketches, which the true
   difference of two sets never falls below, rule out nearly all pairs; the rest is joined to candidate groups without listing
   pairs. A bucket over a size is cut into blocks, and pairs of blocks are dealt out.
3. The sets of candidate groups are loaded once each and put into a trie, most frequent grams first; a walk finds the partners
   of a set, sharing the overlap of common beginnings and leaving subtrees by what can still be gained (see `ngram_trie`). Large
   groups are cut into blocks as well. What a walk confirms is exact; links that connect what is connected already are not listed.
4. Confirmed links give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.common import boxed, cut, one_per_id
from auditlens.llm.components import components, edge_batch, stars
from auditlens.llm.ngram_trie import least_common, spanning_links
from auditlens.llm.vectors import chunks, grams, mix, words

SIZE, PERCENT = 3, 90
CELL_BITS = 19
FREQUENT = 4
BUCKET = 8192
GROUP_GRAMS = 1_500_000
BLOCK = 1024
SMALL = 32
ROWS = 20_000
#: Stands for a NULL id; NULL is an id of its own.
NO_ID = (1 << 63) - 1
CIRCLE = np.minimum(np.arange(256), 256 - np.arange(256)).astype(np.uint8)


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text) without repeats, ordered by text, then gram. A-Z count as a-z."""
    g, owner, _ = grams(*words(texts, lower=True), size)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[new], owner[new]


def _frequent_cells(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of grams far above the mean, with a level that rises with their count. At most one in FREQUENT cells is such."""
    block = 1 << 10

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                g, _ = _sets(texts, size)
                held += np.bincount((g >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(held))
        parts = held.reshape(-1, block)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([parts[k].astype(np.int32).tobytes() for k in full], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                held[part] = held.get(part, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect()
    table = np.zeros(1 << CELL_BITS, np.int64)
    for r in summed:
        table[r.part * block:(r.part + 1) * block] = np.frombuffer(r.counts, np.int64)
    cells = np.flatnonzero(table > FREQUENT * max(1.0, table.mean()))
    return cells, np.clip(np.log2(table[cells] / max(1.0, table.mean())).astype(np.int64), 1, 62)


def _cells_of(n: int, percent: int) -> int:
    """Cells of a sketch, a power of 2: enough that sets without a common gram lie clearly beyond the largest difference allowed."""
    differ = 2 * (100 - percent) / (100 + percent)
    return 1 << max(5, int(2.6 * differ * differ * n).bit_length())


def _profiles(docs: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (id, n, d1, d2, prefix, sketch): size and digest of the set, the first grams in global order, counts per cell."""
    level_of = np.zeros(1 << CELL_BITS, np.uint8)
    level_of[frequent[0]] = frequent[1]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = level_of.astype(np.uint64)
        for batch in batches:
            for first, texts in chunks(batch, "text"):
                g, owner = _sets(texts, size)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                n = np.diff(cuts)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(g ^ np.uint64(k)))]) for k in (1, 2)]
                d1, d2 = ((s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums)
                ranked = (g >> np.uint64(6)) | (levels[(g >> np.uint64(64 - CELL_BITS)).astype(np.int64)] << np.uint64(58))
                ranked = ranked[np.lexsort((ranked, owner))].view(np.int64)
                prefix = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
                at = np.repeat(cuts[:-1] - (np.cumsum(prefix) - prefix), prefix) + np.arange(int(prefix.sum()))
                cell = mix(g ^ np.uint64(3)) >> np.uint64(32)
                sketches = []
                for k in range(len(texts)):
                    m = _cells_of(int(n[k]), percent)
                    part = (cell[cuts[k]:cuts[k + 1]] & np.uint64(m - 1)).astype(np.int64)
                    sketches.append(np.bincount(part, minlength=m).astype(np.uint8).tobytes())
                offsets = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, len(texts)), pa.array(n, pa.int32()), pa.array(d1), pa.array(d2),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ranked[at])), pa.array(sketches, pa.binary())],
                    ["id", "n", "d1", "d2", "prefix", "sketch"])

    return docs.select("id", "text").mapInArrow(profile, "id long, n int, d1 long, d2 long, prefix array<long>, sketch binary")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of the set differences from sketches of equal width, counts modulo 256."""
    return CIRCLE[a - b].sum(axis=-1, dtype=np.int64)


def _fold(sketch: np.ndarray, width: int) -> np.ndarray:
    return sketch.reshape(*sketch.shape[:-1], -1, width).sum(axis=-2, dtype=np.uint8)


def _near(ids: np.ndarray, n: np.ndarray, sketch: pa.Array, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of rows (i, j) may be similar by length and sketch."""
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    near = 100 * low >= percent * high
    offsets = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset:sketch.offset + len(sketch) + 1].astype(np.int64)
    data, wide = np.frombuffer(sketch.buffers()[2], np.uint8), np.diff(offsets)
    at = np.flatnonzero(near)
    for wi, wj in {*zip(wide[i[at]].tolist(), wide[j[at]].tolist())}:
        own = at[(wide[i[at]] == wi) & (wide[j[at]] == wj)]
        for part in np.array_split(own, len(own) * max(wi, wj) // (4 << 20) + 1):
            a, b = data[offsets[i[part]][:, None] + np.arange(wi)], data[offsets[j[part]][:, None] + np.arange(wj)]
            width = min(wi, wj)
            total = n[i[part]] + n[j[part]]
            near[part] = _distances(_fold(a, width), _fold(b, width)) <= total - 2 * least_common(n[i[part]], n[j[part]], percent)
    return near


def _bucket_stars(ids: np.ndarray, n: np.ndarray, sketch: pa.Array, begin: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over what may be linked in buckets whose rows begin at `begin`; with sides, a row meets rows of the other side only.

    Rows of small buckets meet by their distance within the bucket, all buckets at once; in a large one every row meets those
    that no link has joined it to yet, shorter sets first.
    """
    size = np.diff(np.append(begin, len(ids)))
    place = np.arange(len(ids)) - np.repeat(begin, size)
    of = np.repeat(size, size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = of <= SMALL
    for step in range(1, SMALL):
        i = np.flatnonzero(small & (place + step < of))
        if not len(i):
            break
        j = i + step
        if side is not None:
            i, j = i[side[i] != side[j]], j[side[i] != side[j]]
        near = _near(ids, n, sketch, i, j, percent)
        found.append((ids[i[near]], ids[j[near]]))
    for low, count in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist()):
        rows = low + np.argsort(n[low:low + count], kind="stable")
        group, sizes = np.arange(count), n[rows]
        ends = np.searchsorted(percent * sizes, 100 * sizes, "right")
        for k in range(count):
            there = np.arange(k + 1, ends[k])
            there = there[group[there] != group[k]]
            if side is not None:
                there = there[side[rows[there]] != side[rows[k]]]
            if len(there):
                near = there[_near(ids, n, sketch, np.full(len(there), rows[k]), rows[there], percent)]
                if len(near):
                    group[np.isin(group, group[near])] = group[k]
                    found.append((np.full(len(near), ids[rows[k]]), ids[rows[near]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return stars(*(np.concatenate(c) for c in zip(*found)))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where runs of equal keys begin) from batches sorted by the keys; runs are whole, `least` rows or more at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
            if count > least:
                table = pa.Table.from_batches(held).combine_chunks()
                begin = _begins(table, keys)
                if len(begin) > 1:
                    yield table.slice(0, begin[-1]), begin[:-1]
                    held = table.slice(begin[-1]).to_batches()
                    count = sum(b.num_rows for b in held)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _begins(table, keys)


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.ones(table.num_rows, bool)
    values = [table.column(k).to_numpy() for k in keys]
    change[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    return np.flatnonzero(change)


def _paired(df: DataFrame, blocks) -> DataFrame:
    """Rows with (bi, bj, side): each row goes to the pairs of blocks that its own block is part of; a pair of one block is itself."""
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    with_block = df.withColumn("_blocks", blocks).withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int")))
    return (with_block.withColumn("_other", other)
            .withColumn("bi", F.least("_own", "_other")).withColumn("bj", F.greatest("_own", "_other"))
            .withColumn("side", (F.col("_own") == F.col("bj")).cast("int")).drop("_blocks", "_own", "_other"))


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that may be similar, enough to connect all that are."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _runs(batches, ["token", "bi", "bj"], ROWS):
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            sketch = table.column("sketch").combine_chunks()
            sketch = sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch
            same = table.column("bi").to_numpy() == table.column("bj").to_numpy()  # a pair of one block: all differ
            side = np.where(same, np.arange(2, len(ids) + 2), table.column("side").to_numpy())
            yield edge_batch(*_bucket_stars(ids, n, sketch, begin, side, percent))

    tokens = classes.where("n > 0").select("id", F.explode("prefix").alias("token"))
    met = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    drawn = met.join(classes.select("id", "n", "sketch"), "id")
    dealt = _paired(drawn, F.ceil(F.col("df") / BUCKET)).repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj")
    return dealt.select("token", "bi", "bj", "side", "id", "n", "sketch").mapInArrow(meet, "a long, b long")


def _confirmed(docs: DataFrame, groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members of candidate groups that reach the similarity, enough to connect all that do."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch, "text"):
                g, owner = _sets(texts, size)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("grp"), part.column("id"), pa.array([g[cuts[k]:cuts[k + 1]].tobytes() for k in range(len(texts))], pa.binary()),
                     part.column("members"), part.column("total")], ["grp", "id", "grams", "members", "total"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _runs(batches, ["grp", "bi", "bj"]):
            out: list[tuple[int, int]] = []
            for low, high in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows]):
                run = table.slice(low, high - low)
                ids = run.column("id").to_numpy()
                sets = [np.frombuffer(s, np.uint64) for s in run.column("grams").to_pylist()]
                if run.column("bi")[0].as_py() == run.column("bj")[0].as_py():
                    left, right = list(range(len(sets))), None
                    links = spanning_links(sets, None, percent)
                else:
                    side = run.column("side").to_numpy()
                    left, right = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist()
                    links = spanning_links([sets[k] for k in left], [sets[k] for k in right], percent) if left and right else []
                place = left + (right or [])
                out += [(int(ids[place[a]]), int(ids[place[b]])) for a, b in links]
            if out:
                yield edge_batch(*(np.array(c, np.int64) for c in zip(*out)))

    sets = docs.join(groups, "id").select("grp", "id", "text", "members", "total").mapInArrow(
        load, "grp long, id long, grams binary, members long, total long")
    blocks = F.greatest(F.ceil(F.col("total") / GROUP_GRAMS), F.ceil(F.col("members") / BLOCK))
    dealt = _paired(sets, blocks).repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj")
    return dealt.select("grp", "bi", "bj", "side", "id", "grams").mapInArrow(walk, "a long, b long")


def ngram_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id): set size, smallest id of an equal set, smallest id reachable by links.

    A text with fewer words than `size` is one gram as a whole; a NULL or empty text, or one of white space, has no grams and is
    linked with nothing. Rows that repeat an id are one document, with the greatest text. NULL is an id, larger than all
    others. Further columns are not looked at. An empty table gives no rows.
    """
    source = one_per_id(docs.select("doc_id", "text"), "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    profiles = cut(_profiles(source, size, percent, _frequent_cells(source, size)))
    reps = profiles.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    members = cut(profiles.select("id", "n", "d1", "d2").join(reps, ["n", "d1", "d2"], "left").select(
        "id", "n", F.coalesce("rep", "id").alias("rep")))
    classes = profiles.join(members.where("id = rep").select("id"), "id")
    near = components(_candidates(classes, percent)).withColumnRenamed("component", "grp")
    near = near.join(members.select("id", "n"), "id")
    sizes = near.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    groups = cut(near.join(sizes, "grp").select("grp", "id", "members", "total"))
    found = components(_confirmed(source, groups, size, percent)).withColumnsRenamed({"id": "rep", "component": "smallest"})
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (members.join(found, "rep", "left").withColumn("smallest", F.coalesce("smallest", "rep"))
            .select(named("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), named("rep").alias("class_id"),
                    named("smallest").alias("component_id")))


def one_per_component(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Of every component of similar documents the one with the smallest id, all its columns as they were; rows that repeat an id
    are one document, with the greatest text."""
    docs = one_per_id(docs, "doc_id", "text")
    kept = ngram_components(docs, size, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"))
    return boxed(docs, "doc_id").join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
