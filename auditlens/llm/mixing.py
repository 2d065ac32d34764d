"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. The copies' prefix sum within the
source, started at one random offset, emits a document once per integer that it crosses. Documents are taken in an order of
small pieces (by a hash of the id), and by size inside a piece, rising and falling in turn, so that each stretch of the sum
holds all sizes and the words taken keep close to the target. The random offset of a source is the one, of a few that lie evenly
round the circle, with which the words taken come nearest; this matters where one document is a large part of its source.

The prefix sum has two levels, so that a source with a third of all rows is no one task's work: a window numbers the rows inside
a piece of about `piece` documents, and a second one, over one row per piece, tells what went before. Sources are few against
documents: the table of targets has one row for each, made by map-side sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.common import WORD, boxed, cut, one_per_id

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
PIECE = 1_000
OFFSETS = 16
SEED = "mix"


def _share(key: Column, seed: str, digits: int) -> Column:
    """A fixed number in [0, 1) for a value, of so many hexadecimal digits."""
    named = F.coalesce(F.concat(F.lit(seed + ":"), key.cast("string")), F.lit(seed))
    return F.conv(F.substring(F.md5(named), 1, digits), 16, 10).cast("double") / F.lit(float(16 ** digits))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Rows (source, n_docs, source_size, target). `sizes` holds (source, size).

    Weights repeat over the sources by code point, NULL last. Together the targets are all words. One that would exceed
    max_copies times its source's size stops there, and the rest is shared again by weight: with sources in order of
    cap / weight, the stopped ones are a prefix, and level = (total - their caps) / (weights of the rest) is what a weight of
    1 gets. A source without words has a target of 0.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = (F.lit(max_copies) * F.col("source_size")).cast("double")
    listed = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights)))).cast("double"))
    listed = listed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = (listed
              .withColumn("caps", F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
              .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
              .withColumn("level", (F.sum("source_size").over(every) - F.col("caps")) / F.col("left"))
              .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_size", "level"))).over(every)["level"]))
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    return levels.select("source", "n_docs", "source_size", F.coalesce(target, F.col("cap")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED,
             piece: int = PIECE, offsets: int = OFFSETS) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken), one per document.

    Size is the number of words; a NULL or empty text has none and its copies take none. Repeated rows are documents of their
    own. The same table gives the same copies. A NULL source is a source. Further columns are not looked at.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = cut(sized)
    targets = source_targets(sized, weights, max_copies).withColumnRenamed("source", "_source")
    known = sized.join(targets, sized.source.eqNullSafe(F.col("_source"))).drop("_source")
    pieces = F.greatest(F.lit(1), F.floor(F.col("n_docs") / piece))
    dealt = known.withColumn("_piece", F.floor(_share(F.col("doc_id"), seed, 12) * pieces).cast("long"))
    counted = dealt.groupBy("source", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(F.col("source").alias("_source"), F.col("_piece").alias("_at"),
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    swing = F.when(F.col("_piece") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    inside = Window.partitionBy("source", "_piece").orderBy(swing, "doc_id")
    placed = cut(dealt.withColumn("_inside", F.row_number().over(inside)).join(
        starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_piece") == F.col("_at"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_before") + F.col("_inside")).cast("double").alias("_place")))
    tried = [F.struct(F.abs(F.sum(_copies(F.lit(j / offsets), seed) * F.col("size")) - F.first("target")).alias("miss"),
                      F.lit(j / offsets).alias("shift")) for j in range(offsets)]
    best = placed.groupBy("source").agg(F.least(*tried)["shift"].alias("_shift") if offsets > 1 else F.lit(0.0).alias("_shift"))
    best = best.withColumnRenamed("source", "_source")
    chosen = placed.join(best, F.col("source").eqNullSafe(F.col("_source")))
    return chosen.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("_shift"), seed).alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size"))


def _copies(shift: Column, seed: str = SEED) -> Column:
    """How many integers the prefix sum crosses at a document, when it starts at the source's offset moved by `shift`."""
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _share(F.col("source"), seed, 5) + shift
    return (F.floor(start + each * F.col("_place")) - F.floor(start + each * (F.col("_place") - 1))).cast("long")


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as the plan takes it, all columns as they are. Rows that repeat an id are one
    document, with the greatest text."""
    docs = one_per_id(docs, "doc_id", "text")
    plan = mix_plan(docs.select("doc_id", "text", "source"), **options).where("copies > 0").select(F.col("doc_id").alias("plan_id"), "copies")
    joined = boxed(docs, "doc_id").join(plan, F.col("doc_id").eqNullSafe(F.col("plan_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
