"""Benchmark passages in documents, by greedy string tiling of the tokens they share.

Seeds are hashes of `SEED` tokens in a row. A bitmap of all benchmark seeds, of a fixed size, goes to the tasks; with it a document is
cut down to the stretches of tokens that are made of benchmark seeds, and every tile lies in one of these. Pairs come from a
join on seeds; an item needs `least seeds` of its own to be covered enough, so its commonest ones, up to one less than that,
cannot decide and stay out of the join. The tiles of a pair are then marked longest first, so that passages whose parts come in another
order are found as well; a pair counts if they cover enough of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.common import boxed, cut, one_per_id
from auditlens.llm.tiling import tiles
from auditlens.llm.vectors import NO_TOKEN, chunks, grams, words

SEED, COVERAGE = 5, 0.6
BITS = 24
NO_ID = (1 << 63) - 1
BREAK = 0


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits, A-Z as a-z; bytes beyond ASCII count as letters."""
    return words(texts, lower=True, gap=NO_TOKEN)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in chunks(batch, "text"):
            h, owner, counts = _tokens(texts)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            g, of, place = grams(h, owner, counts, SEED)
            full = counts[of] >= SEED
            g, of = g[full], of[full]
            seeds = np.searchsorted(of, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("item").slice(first, len(texts)),
                pa.array([h[cuts[k]:cuts[k + 1]].view(np.int64) for k in range(len(texts))], pa.list_(pa.int64())),
                pa.array([g[seeds[k]:seeds[k + 1]].view(np.int64) for k in range(len(texts))], pa.list_(pa.int64()))], ["item", "tokens", "seeds"])


def _bitmap(items: DataFrame) -> np.ndarray:
    """One bit for each cell that a benchmark seed falls into, 2 MB however large the benchmark is."""
    cells = items.select(F.explode("seeds").alias("seed")).select(F.shiftrightunsigned("seed", 64 - BITS).alias("cell")).distinct()
    bits = cells.selectExpr("shiftright(cell, 6) as word", "shiftleft(1L, cast(cell & 63 as int)) as bit")
    packed = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).select("word", "bits").toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[packed.column("word").to_numpy()] = packed.column("bits").to_numpy()
    return table


def _stretches(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Rows (id, hits, tokens) of documents with benchmark seeds: the distinct seeds, the stretches made of them, breaks between."""
    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch, "text"):
                h, owner, counts = _tokens(texts)
                g, of, place = grams(h, owner, counts, SEED)
                cell = (g >> np.uint64(64 - BITS)).astype(np.int64)
                hit = (bitmap[cell >> 6] >> (cell & 63)) & 1 == 1
                hit &= counts[of] >= SEED
                if not hit.any():
                    continue
                g, of, place = g[hit], of[hit], place[hit]
                begin = np.concatenate([[0], np.cumsum(counts)])
                at = begin[of] + place
                ids, hits, kept = batch.column("id").slice(first, len(texts)), [], []
                edges = np.flatnonzero(np.diff(of, prepend=-1))
                for low, high in zip(edges, np.append(edges[1:], len(of))):
                    own, parts = at[low:high], []
                    breaks = np.flatnonzero(np.diff(own) >= SEED)  # stretches that do not even touch
                    for a, z in zip(np.concatenate([[0], breaks + 1]), np.append(breaks, len(own) - 1)):
                        parts += [h[own[a]:own[z] + SEED].view(np.int64), np.array([BREAK])]
                    hits.append(np.unique(g[low:high]).view(np.int64))
                    kept.append(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[edges])), pa.array(hits, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int64()))],
                                                 ["id", "hits", "tokens"])

    return docs.mapInArrow(cut_down, "id long, hits array<long>, tokens array<long>")


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rid, item, text, pattern in zip(*(batch.column(c) for c in ("id", "item", "tokens", "pattern"))):
            a, b = pattern.values.to_numpy().view(np.uint64), text.values.to_numpy()
            stops = np.flatnonzero(b == BREAK)
            b = b.view(np.uint64).copy()
            b[stops] = np.arange(len(stops), dtype=np.uint64) + np.uint64(1)  # no two breaks are alike, and no token is so small
            found = tiles(a, b, SEED)
            out.append((rid.as_py(), item.as_py(), len(a), sum(t[2] for t in found), len(found)))
        kinds = [("id", pa.int64()), ("item", pa.int64()), ("n_tokens", pa.int64()), ("n_covered", pa.int64()), ("n_tiles", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [[]] * 5, kinds)], [k for k, _ in kinds])


def contaminations(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Rows (doc_id, item_id, n_tokens, n_covered, n_tiles, coverage): documents that hold so much of a benchmark item.

    NULL and empty texts hold nothing and are held by nothing, and items of fewer than `SEED` tokens are too short to tell.
    Rows that repeat an id are one document or item, with the greatest text; NULL is an id. Further columns are not looked at.
    Two breaks never match. Empty tables give no rows.
    """
    named = lambda df, key, name: one_per_id(df.select(key, "text"), key, "text").select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias(name), "text")
    items = cut(named(benchmark, "item_id", "item").mapInArrow(_items, "item long, tokens array<long>, seeds array<long>").where("size(seeds) > 0"))
    stretches = cut(_stretches(named(docs, "doc_id", "id"), _bitmap(items)))
    need = F.ceil(F.ceil(F.size("tokens") * F.lit(coverage)) / SEED)
    seeds = items.select("item", need.alias("need"), F.explode("seeds").alias("h"))
    spread = seeds.groupBy("h").agg(F.countDistinct("item").alias("n"))
    order = Window.partitionBy("item").orderBy(F.desc("n"), "h")
    chosen = (seeds.join(spread, "h").withColumn("place", F.row_number().over(order)).where(F.col("place") >= F.col("need"))
              .select("item", "h").distinct())
    pairs = stretches.select("id", F.explode("hits").alias("h")).join(chosen, "h").select("id", "item").distinct()
    both = pairs.join(stretches.select("id", "tokens"), "id").join(items.select("item", F.col("tokens").alias("pattern")), "item")
    tiled = both.select("id", "item", "tokens", "pattern").mapInArrow(_tiled, "id long, item long, n_tokens long, n_covered long, n_tiles long")
    named_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (tiled.withColumn("coverage", F.col("n_covered") / F.col("n_tokens")).where(F.col("coverage") >= coverage)
            .select(named_id("id").alias("doc_id"), named_id("item").alias("item_id"), "n_tokens", "n_covered", "n_tiles", "coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no benchmark item, all their columns as they were; rows that repeat an id are one document, with
    the greatest text."""
    docs = one_per_id(docs, "doc_id", "text")
    found = contaminations(docs, benchmark, coverage).select(F.col("doc_id").alias("found_id")).distinct()
    return boxed(docs, "doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left_anti").select("row.*")
