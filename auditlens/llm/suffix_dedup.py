"""Exact removal of repeated passages over whole texts with sorted suffixes.

A byte goes if a string of `width` bytes over it starts earlier as well. Not all suffixes are sorted, only those at anchors: each
window of `width` bytes has its anchor where the hash of `GRAM` bytes is smallest inside it, so equal windows have equal anchors,
and neighbouring windows share one.

1. Every text gives its anchors, each with a hash of the `GRAM` bytes there; a task hands over the segments of one hash in lists.
   Anchors whose hash occurs once have no repeated window; that is all the hash decides.
2. The segments of all others, equal ones too, are sorted: Spark range-partitions the suffixes from the anchor on, with sampled
   splitters, into buckets of about `SORTED` rows; copies of one suffix are dealt on by document, so they may fill any number of
   buckets. A bucket sorts its suffixes by multikey quicksort; neighbours' common prefixes, with the bytes to the left, tell which
   windows are equal. A class in the first or last run of a bucket may go on in another bucket, so buckets hand over the first
   window of each such class, and these are compared across boundaries.
3. The intervals are joined to the texts, which travel compressed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.common import cut, one_per_id
from auditlens.llm.suffix_sort import Bucket
from auditlens.llm.vectors import chunks, prefix_sums, stretch_hashes

WIDTH = 100
GRAM = 24
PIECE = 4 << 20
FLUSH = 600_000
LISTED = 512
SORTED = 150_000
BATCH = 20_000
NO_ID = (1 << 63) - 1
LOW = np.uint64((1 << 24) - 1)


def _anchors(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, anchor hash) of all windows of all texts, joined to segments."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < width:
        return none
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    held = stretch_hashes(sums, at, at + gram)
    best = (held & ~LOW) | at.astype(np.uint64)
    span, have = width - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    starts = np.arange(len(best))
    owner = np.searchsorted(ends, starts, "right")
    inside = starts + width <= ends[owner]
    starts, owner = starts[inside], owner[inside]
    anchor = (best[starts] & LOW).astype(np.int64)
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    last = starts[np.append(at[1:], len(starts)) - 1]
    first, anchor, owner = starts[at], anchor[at], owner[at]
    begin = np.concatenate([[0], ends[:-1]])[owner]
    return owner, anchor - begin, first - begin, last - begin, held[anchor]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, offsets, pieces): long texts in pieces that overlap by less than a window, so that each window is in one."""
    ids = batch.column("id").to_numpy()
    for first, texts in chunks(batch, "text"):
        if len(texts) > 1 or len(texts[0]) <= PIECE:
            yield ids[first:first + len(texts)], np.zeros(len(texts), np.int64), texts
        else:
            for at in range(0, max(1, len(texts[0]) - WIDTH + 1), PIECE):
                yield ids[first:first + 1], np.full(1, at), [texts[0][at:at + PIECE + WIDTH - 1]]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, at): for one hash of anchors up to `LISTED` segments, each as two numbers: its document, and its first start, the
    way to the anchor and the number of further starts in one."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        h, rid, at = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(new)
        place = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
        row = np.flatnonzero(place % LISTED == 0)
        values = np.stack([rid[order], at[order]], axis=1).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.append(row, len(h)) * 2, pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays([pa.array(h[row].view(np.int64)), lists], ["h", "at"])

    for batch in batches:
        for ids, offset, texts in _pieces(batch):
            owner, anchor, first, last, h = _anchors(texts, WIDTH, GRAM)
            held.append((h, ids[owner], (first + offset[owner] << 16) + (anchor - first << 8) + last - first))
            count += len(h)
            if count > FLUSH:
                yield flush()
                held, count = [], 0
    if count:
        yield flush()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (suffix, left, id, anchor) of the segments that a text is asked for."""
    def rows(out: list[tuple[bytes, bytes, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64(), pa.int64()))],
                                          ["suffix", "left", "id", "anchor"])

    out: list[tuple[bytes, bytes, int, int]] = []
    for batch in batches:
        for rid, packed, wanted in zip(batch.column("id").to_pylist(), batch.column("z"), batch.column("wanted")):
            text = zlib.decompress(packed.as_py())
            for value in wanted.values.to_pylist():
                first, more = value >> 16, value & 255
                at = first + (value >> 8 & 255)
                out.append((text[at:first + more + WIDTH], text[first:at][::-1], rid, at))
                if len(out) == BATCH:
                    yield rows(out)
                    out = []
    if out:
        yield rows(out)


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, span, k1, k2): intervals found here, and with a digest the windows to be compared across boundaries."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    bucket = Bucket(table.column("suffix").to_pylist(), table.column("left").to_pylist(), table.column("id").to_numpy(),
                    table.column("anchor").to_numpy(), WIDTH)
    rid, first, last = bucket.intervals()
    names = ["id", "span", "k1", "k2"]
    none = pa.nulls(len(rid), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array((first << 8) + last - first), none, none], names)
    edges = bucket.edges()
    for at in range(0, len(edges), 50_000):
        k1, k2, rid, start = (pa.array(c, pa.int64()) for c in zip(*edges[at:at + 50_000]))
        yield pa.RecordBatch.from_arrays([rid, pa.array(start.to_numpy() << 8), k1, k2], names)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(texts)), pa.array([zlib.compress(t, 1) for t in texts], pa.binary())], ["id", "z"])


def _removed(intervals: np.ndarray, width: int) -> np.ndarray:
    """Maximal byte runs (begin, end) covered by windows whose starts lie in the intervals (first, last)."""
    if not len(intervals):
        return np.zeros((0, 2), np.int64)
    intervals = intervals[np.lexsort((intervals[:, 1], intervals[:, 0]))]
    begin, end = intervals[:, 0], np.maximum.accumulate(intervals[:, 1] + width)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return np.stack([begin[at], end[np.append(at[1:], len(begin)) - 1]], axis=1)


def interval_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, span) found within buckets and across their boundaries: windows that occur earlier, as the first start times 256
    plus the number of further ones; `docs` holds unique id and text."""
    segments = docs.mapInArrow(_segments, "h long, at array<long>")
    met = segments.withColumn("_all", F.sum(F.size("at")).over(Window.partitionBy("h"))).where("_all > 2")
    pairs = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda k: F.struct(
        F.get("at", k).alias("id"), F.get("at", k + 1).alias("at")))
    wanted = cut(met.select(F.inline(pairs)).groupBy("id").agg(F.collect_list("at").alias("wanted")))
    rows = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    suffixes = docs.mapInArrow(_pack, "id long, z binary").join(wanted, "id").mapInArrow(
        _cut_out, "suffix binary, left binary, id long, anchor long")
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows // SORTED))
    dealt = suffixes.repartitionByRange(buckets, "suffix", "id")
    found = cut(dealt.mapInArrow(_sorted_bucket, "id long, span long, k1 long, k2 long"))
    first = Window.partitionBy("k1", "k2").orderBy("id", "span")
    across = found.where("k1 is not null").withColumn("n", F.row_number().over(first)).where("n > 1")
    return found.where("k1 is null").select("id", "span"), across.select("id", "span")


def dedup_passages(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, the kept bytes and the removed runs.

    Texts are UTF-8 bytes; NULL is empty; texts under `WIDTH` bytes lose nothing. Rows that repeat an id are one document, with
    the greatest text; NULL is an id, after all others. Further columns are not looked at. An empty table gives no rows.
    """
    source = one_per_id(docs.select("doc_id", "text"), "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, packed, spans in zip(batch.column("id").to_pylist(), batch.column("z"), batch.column("spans")):
                text = zlib.decompress(packed.as_py())
                held = spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64)
                runs = _removed(np.stack([held >> 8, (held >> 8) + (held & 255)], axis=1), WIDTH)
                kept = b"".join(text[a:b] for a, b in zip([0, *runs[:, 1].tolist()], [*runs[:, 0].tolist(), len(text)]))
                out.append((None if rid == NO_ID else rid, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                            kept if texts else None, runs.ravel().tolist() if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "runs"])

    within, across = interval_parts(source)
    spans = within.union(across).groupBy("id").agg(F.collect_list("span").alias("spans"))
    joined = source.mapInArrow(_pack, "id long, z binary").join(spans, "id", "left")
    done = joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, runs array<long>")
    return done if texts else done.drop("kept", "runs")
