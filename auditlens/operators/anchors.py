"""Anchors of the ledger: one root hash per batch over all its chains, the roots chained over the batches.

A manifest finds chains that are gone, but a batch whose manifest rows are gone with its entries leaves no trace there. An anchor
is one short row per batch that holds the root of a hash tree over the batch's manifest, and the anchor of the batch before. Removing
a batch breaks the chain of anchors; changing a listed chain changes its root. The newest anchor, kept anywhere else, covers
every entry ever written.

The tree needs no numbering of its leaves: a leaf's place is its own hash, two digits a level, so every level is one grouping whose
groups have at most 256 members, the lowest a 16-millionth of the batch's chains. A chain is shown to be part of an anchored batch by
the members of the groups above it, without the rest of the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.hashing import sha256_text
from auditlens.operators.ledger import GENESIS

LEVELS = (6, 4, 2, 0)
ANCHORS = "number bigint, batch string, chains bigint, entries bigint, root string, prev_anchor string, anchor string"
GAP_REASON = "the anchor before is missing: a batch was removed"
LINK_REASON = "the anchor before is another than this one was made after"
ANCHOR_REASON = "the anchor does not match its content: it was changed afterwards"
GONE_REASON = "the batch is anchored but none of its chains is listed"
ROOT_REASON = "the chains listed for the batch are not those anchored"
LOOSE_REASON = "the batch is listed but not anchored"
HEAD_REASON = "the newest anchor known is not there"


def _leaf() -> Column:
    return sha256_text(F.concat_ws("|", "chain", F.col("entries").cast("string"), "head"))


def _levels(listed: DataFrame) -> Iterator[DataFrame]:
    """Groups of the tree from the leaves up: (batch, path, members, chains, entries, hash)."""
    rows = listed.select("batch", _leaf().alias("path"), _leaf().alias("member"), F.lit(1).cast("bigint").alias("chains"), "entries")
    for width in LEVELS:
        groups = rows.groupBy("batch", F.substring("path", 1, width).alias("path")).agg(
            F.array_sort(F.collect_list("member")).alias("members"), F.sum("chains").alias("chains"), F.sum("entries").alias("entries"))
        groups = groups.withColumn("hash", sha256_text(F.array_join("members", "|")))
        yield groups
        rows = groups.select("batch", "path", F.concat("path", F.lit(":"), "hash").alias("member"), "chains", "entries")


def batch_roots(listed: DataFrame) -> DataFrame:
    """(batch, chains, entries, root) of the batches in a manifest."""
    *_, top = _levels(listed)
    return top.select("batch", "chains", "entries", F.col("hash").alias("root"))


def anchor_batches(listed: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Anchors of the batches in a manifest that have none yet, by name, after the newest of `anchors`.

    One short row per batch streams through one sorted partition, with one hash of state.
    """
    roots, number, prev = batch_roots(listed), 0, GENESIS
    if anchors is not None:
        newest = anchors.agg(F.max("number"), F.max_by("anchor", "number")).first()
        number, prev = newest[0] or 0, newest[1] or GENESIS
        roots = roots.join(anchors.select("batch"), "batch", "left_anti")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, before = number, prev
        for pdf in batches:
            numbers, befores, hashes = [], [], []
            for row in pdf.itertuples(index=False):
                n += 1
                numbers.append(n)
                befores.append(before)
                before = hashlib.sha256(f"{n}|{row.batch}|{row.chains}|{row.entries}|{row.root}|{before}".encode()).hexdigest()
                hashes.append(before)
            yield pdf.assign(number=numbers, prev_anchor=befores, anchor=hashes)[["number", "batch", "chains", "entries", "root", "prev_anchor", "anchor"]]

    return roots.repartition(1).sortWithinPartitions("batch").mapInPandas(chain, ANCHORS)


def verify_anchors(listed: DataFrame, anchors: DataFrame, head: tuple[int, str] | None = None) -> DataFrame:
    """(number, batch, reason) of all that does not hold between a manifest, its anchors and, if given, the newest anchor known.

    Anchors are judged in parallel, each with the one before. Together with `verify_manifest` and `verify_chain` this covers
    batches, chains and entries.
    """
    before = anchors.select((F.col("number") + 1).alias("number"), F.col("anchor").alias("_before"))
    now = batch_roots(listed).select("batch", F.col("root").alias("_root"))
    content = sha256_text(F.concat_ws("|", *[F.col(c).cast("string") for c in ("number", "batch", "chains", "entries", "root", "prev_anchor")]))
    linked = anchors.join(before, "number", "left").withColumn("_before", F.when(F.col("number") == 1, GENESIS).otherwise(F.col("_before")))
    judged = linked.join(now, "batch", "full").select(
        "number", "batch",
        F.when(F.col("number").isNull(), LOOSE_REASON).when(F.col("_before").isNull(), GAP_REASON)
        .when(F.col("_before") != F.col("prev_anchor"), LINK_REASON).when(F.col("anchor") != content, ANCHOR_REASON)
        .when(F.col("_root").isNull(), GONE_REASON).when(F.col("_root") != F.col("root"), ROOT_REASON).alias("reason")).where("reason is not null")
    if head is None:
        return judged
    known = anchors.where((F.col("number") == head[0]) & (F.col("anchor") == head[1])).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return judged.unionByName(known.select(F.lit(head[0]).cast("bigint").alias("number"), F.lit(None).cast("string").alias("batch"), F.lit(HEAD_REASON).alias("reason")))


def inclusion_proofs(listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(batch, chain, entries, head, steps) for the chains (batch, chain) in `wanted`: the members of the groups above each."""
    proofs = listed.join(wanted.select("batch", "chain").distinct(), ["batch", "chain"]).select("batch", "chain", "entries", "head", _leaf().alias("_leaf"))
    for width, groups in zip(LEVELS, _levels(listed)):
        members = groups.select("batch", F.col("path").alias("_path"), F.col("members").alias(f"_{width}"))
        proofs = proofs.withColumn("_path", F.substring("_leaf", 1, width)).join(members, ["batch", "_path"]).drop("_path")
    return proofs.select("batch", "chain", "entries", "head", F.array(*[F.col(f"_{w}") for w in LEVELS]).alias("steps"))


def verify_proofs(proofs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(batch, chain, ok): whether the chain, with these entries and this head, is part of the batch as anchored. Looks at nothing else."""
    leaf = _leaf()
    member, ok, node = leaf, F.lit(True), F.lit(None)
    for k, width in enumerate(LEVELS):
        members = F.get("steps", F.lit(k))
        ok = ok & F.array_contains(members, member)
        node = sha256_text(F.array_join(F.array_sort(members), "|"))
        member = F.concat(F.substring(leaf, 1, width), F.lit(":"), node)
    return proofs.join(anchors.select("batch", "root"), "batch", "left").select(
        "batch", "chain", F.coalesce(ok & (node == F.col("root")), F.lit(False)).alias("ok"))
