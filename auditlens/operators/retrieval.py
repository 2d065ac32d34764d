"""Ranking documents for queries: BM25, cosine, and their fusion by rank.

queries: (query_id, text); docs: (doc_id, doc_order, text); vectors: (query_id | doc_id, vec).
Equal scores go to the document with the larger doc_order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.rows import sized, top_per_group

# --- fixed values: scoring constants ---
K1, B, IDF_FLOOR = 1.5, 0.75, 0.25
RRF_DAMPING, POOL = 60, 25
# --- end of fixed values ---

_ROUND = 9
_TERM_SALTS = 8
_BLOCK_ROWS = 4096
#: Terms of queries, counted first, that are sent to every task; more are joined with a shuffle.
BROADCAST_TERMS = 500_000
#: Characters of text, and scores, that one task holds at about; there are as many tasks as that takes.
TASK_CHARS, TASK_SCORES = 8_000_000, 1_000_000


def doc_parts(docs: DataFrame, n_queries: int = 0) -> int:
    """Parts that documents are laid out in, so that a part is no larger over more of them.

    Spark cuts by the bytes that move; a part's postings and scores take some fifty times those.
    """
    n, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS), -(-n * n_queries // TASK_SCORES))


def postings(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, doc_order, dl, term, tf), laid out by document: texts move once, and are smaller than their postings.

    The length is taken before the unfolding: next to explode() it would be worked out per word.
    """
    laid = docs.select("doc_id", "doc_order", "text").repartition(parts or doc_parts(docs), "doc_id")
    split = laid.select("doc_id", "doc_order", tx.tokenize(F.col("text")).alias("tokens"))
    measured = split.select("doc_id", "doc_order", F.size("tokens").alias("dl"), "tokens")
    return (
        measured.select("doc_id", "doc_order", "dl", F.explode("tokens").alias("term"))
        .groupBy("doc_id", "doc_order", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def term_weights(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(term, idf, avgdl). A term in more than half of the documents gets a quarter of the mean weight."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    df = sized(index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("words")))  # read three times below
    avgdl = df.agg(F.sum("words").cast("double")).scalar() / n  # the lengths add up to the counts: no text is split for them
    raw = df.select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg(F.avg("raw") * IDF_FLOOR).scalar()
    return raw.select("term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"), avgdl.alias("avgdl"))


def bm25_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, doc_order, score) with score > 0. A word repeated in the query counts each time."""
    index = postings(docs, doc_parts(docs, queries.count()))
    asked = queries.select("query_id", F.explode(tx.tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("qtf"))
    weights = term_weights(docs, index)
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("qtf") * F.col("idf") * (tf * (K1 + 1)) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.col("avgdl")))
    wanted = asked.join(weights, "term")
    if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        # Every document's terms lie together, so its scores are summed where they are; only the best of a partition move on.
        met = index.join(F.broadcast(wanted), "term")
    else:
        # The postings of a common word are spread over salts.
        wanted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_TERM_SALTS - 1))))
        met = index.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(_TERM_SALTS)).cast("int")).join(wanted, ["term", "_salt"])
    scores = met.groupBy("query_id", "doc_id", "doc_order").agg(
        F.round(F.sum(part), _ROUND).alias("score"))
    return scores.where("score > 0")


def bm25_rank(queries: DataFrame, docs: DataFrame, pool: int | None = POOL) -> DataFrame:
    """0-based bm25_rank per query; every match when pool is None."""
    scores = bm25_scores(queries, docs)
    order = [F.desc("score"), F.desc("doc_order")]
    if pool is None:
        ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    else:
        ranked = top_per_group(scores, ["query_id"], order, pool)
    return ranked.select("query_id", "doc_id", "doc_order", (F.col("rank") - 1).alias("bm25_rank"))


def unit(vec: Column) -> Column:
    """A vector as doubles of length 1."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / norm)


def cosine(a: Column, b: Column) -> Column:
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), _ROUND)


def dense_rank(query_vectors: DataFrame, doc_vectors: DataFrame, pool: int = POOL, doc_blocks: int | None = None,
               query_blocks: int | None = None) -> DataFrame:
    """The `pool` nearest documents of every query, exact (query_id, doc_id, dense_rank).

    Both sides are cut into blocks by hash, block meets block in one matrix product, and only the best of
    each block pair leave it. No task ever sees more than two blocks.
    """
    def blocks(df: DataFrame, given: int | None) -> int:
        return given or max(1, -(-df.count() // _BLOCK_ROWS))

    nd, nq = blocks(doc_vectors, doc_blocks), blocks(query_vectors, query_blocks)
    d = doc_vectors.select(F.col("doc_id"), F.col("doc_order"), unit(F.col("vec")).alias("vec"),
                           F.pmod(F.xxhash64("doc_id"), F.lit(nd)).cast("int").alias("db"),
                           F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    q = query_vectors.select(F.col("query_id"), unit(F.col("vec")).alias("vec"),
                             F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"),
                             F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("db"))
    qt, dt = query_vectors.schema["query_id"].dataType, doc_vectors.schema["doc_id"].dataType
    ot = doc_vectors.schema["doc_order"].dataType
    schema = f"query_id {qt.simpleString()}, doc_id {dt.simpleString()}, doc_order {ot.simpleString()}, score double"

    def best(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or docs.empty:
            return pd.DataFrame({"query_id": queries["query_id"][:0], "doc_id": docs["doc_id"][:0],
                                 "doc_order": docs["doc_order"][:0], "score": np.zeros(0)})
        docs = docs.sort_values("doc_order", ascending=False, kind="stable").reset_index(drop=True)
        scores = np.round(np.stack(queries["vec"].to_list()) @ np.stack(docs["vec"].to_list()).T, _ROUND)
        keep = np.argsort(-scores, axis=1, kind="stable")[:, :pool]
        rows = np.repeat(np.arange(len(queries)), keep.shape[1])
        flat = keep.ravel()
        return pd.DataFrame({
            "query_id": queries["query_id"].to_numpy()[rows], "doc_id": docs["doc_id"].to_numpy()[flat],
            "doc_order": docs["doc_order"].to_numpy()[flat], "score": scores[rows, flat]})

    near = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(best, schema)
    ranked = top_per_group(near, ["query_id"], [F.desc("score"), F.desc("doc_order")], pool)
    return ranked.select("query_id", "doc_id", "doc_order", (F.col("rank") - 1).alias("dense_rank"))


def rrf_fuse(bm25: DataFrame, dense: DataFrame | None) -> DataFrame:
    """Union of two pools with score = sum of 1 / (60 + rank), ranks from 0."""
    by_word = bm25.select("query_id", "doc_id", "doc_order", "bm25_rank", F.lit(None).cast("int").alias("dense_rank"))
    if dense is not None:
        by_word = by_word.unionByName(dense.select("query_id", "doc_id", "doc_order", F.lit(None).cast("int").alias("bm25_rank"), "dense_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF_DAMPING) + F.col(c)), F.lit(0.0))
    return (
        by_word.groupBy("query_id", "doc_id", "doc_order").agg(F.min("bm25_rank").alias("bm25_rank"), F.min("dense_rank").alias("dense_rank"))
        .withColumn("score", F.round(share("bm25_rank") + share("dense_rank"), 12))
    )


def pools(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame | None = None, doc_vectors: DataFrame | None = None,
          pool: int = POOL) -> tuple[DataFrame, DataFrame | None]:
    """The best `pool` documents of every query by words and by vectors. What is made of them in one query shares their shuffles."""
    words = bm25_rank(queries, docs, pool)
    if query_vectors is None or doc_vectors is None:
        return words, None
    vectors = doc_vectors.join(docs.select("doc_id", "doc_order"), "doc_id").select("doc_id", "doc_order", "vec")
    return words, dense_rank(query_vectors, vectors, pool)


def _hits(words: DataFrame, near: DataFrame | None, k: int, strategy: str) -> DataFrame:
    """Top k of one strategy from the pools; a hit of the vectors keeps its rank by words."""
    if strategy not in ("bm25", "dense", "rrf"):
        raise ValueError(f"unknown strategy {strategy!r}")
    fused = rrf_fuse(words, near if strategy != "bm25" else None)
    if strategy == "dense":
        by_vector = F.lit(1.0) / (F.lit(RRF_DAMPING) + F.col("dense_rank"))
        fused = fused.where(F.col("dense_rank").isNotNull()).withColumn("score", F.round(by_vector, 12))
    order = [F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("dense_rank")]
    return top_per_group(fused, ["query_id"], order, k)


def _with_cosine(hits: DataFrame, query_vectors: DataFrame | None, doc_vectors: DataFrame | None) -> DataFrame:
    if query_vectors is None or doc_vectors is None:
        return hits.withColumn("cosine", F.lit(0.0))
    return (
        hits.join(query_vectors.select("query_id", unit(F.col("vec")).alias("_q")), "query_id", "left")
        .join(doc_vectors.select("doc_id", unit(F.col("vec")).alias("_d")), "doc_id", "left")
        .withColumn("cosine", F.coalesce(cosine(F.col("_q"), F.col("_d")), F.lit(0.0)))
    )


_HIT = ["query_id", "rank", "doc_id", "score", "bm25_rank", "dense_rank", "cosine"]


def search(queries: DataFrame, docs: DataFrame, k: int = 5, strategy: str = "rrf", *,
           query_vectors: DataFrame | None = None, doc_vectors: DataFrame | None = None, pool: int = POOL) -> DataFrame:
    """Top k per query: (query_id, rank from 1, doc_id, score, bm25_rank, dense_rank, cosine).

    Without vectors the dense side is empty and its cosine is 0, so 'rrf' becomes BM25; so it does where only words are asked for.
    """
    if strategy == "bm25":
        query_vectors = doc_vectors = None
    words, near = pools(queries, docs, query_vectors, doc_vectors, pool)
    return _with_cosine(_hits(words, near, k, strategy), query_vectors, doc_vectors).select(*_HIT)


def compare_strategies(queries: DataFrame, docs: DataFrame, k: int = 5, *, query_vectors: DataFrame | None = None,
                       doc_vectors: DataFrame | None = None) -> DataFrame:
    """The three strategies side by side, over one pool by words and one by vectors."""
    words, near = pools(queries, docs, query_vectors, doc_vectors)
    words, near = sized(words), near if near is None else sized(near)  # at most `POOL` rows a query, read by every strategy
    out = None
    for s in ("bm25", "dense", "rrf"):
        hits = _hits(words, near, k, s)
        part = _with_cosine(hits, *((None, None) if s == "bm25" else (query_vectors, doc_vectors))).select(*_HIT, F.lit(s).alias("strategy"))
        out = part if out is None else out.unionByName(part)
    return out


def candidate_block(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Per query its candidates in rank order, each with a tag, up to six aliases and its cosine."""
    facts = rules.select(
        F.col("chunk_id").alias("doc_id"), F.coalesce("list_name", "topic", F.lit("policy")).alias("tag"), "title",
        F.slice("aliases", 1, 6).alias("aliases"))
    entry = F.struct("rank", "doc_id", "tag", "title", "aliases", F.round("cosine", 2).alias("cosine"))
    return hits.join(facts, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
