"""Admission of one very busy key by many tasks: pointers to the next acceptance, and their doubling.

A request is accepted when more than the lifetime has passed since the last acceptance, so the acceptances of a key are the orbit of
its first moment under "first moment after this one's lifetime". Every moment gets that pointer by a range search in slices of time;
pointers are doubled until they span the whole history, which takes as many rounds as its number of lifetimes has binary digits; the
orbit is read off from the longest to the shortest pointers. No window goes over the rows of a key, only over its slices.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.functions.rows import salted_left_join
from auditlens.session import shared_dir

#: Rows a slice of time holds on average, and the most slices that the time of a table is cut into.
SLICE_ROWS, MOST_SLICES = 50_000, 100_000


def instant(frame: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    ts = F.col(name)
    if dict(frame.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(ts)
    day = F.date_diff(ts.cast("date"), F.lit(dt.date(1970, 1, 1))).cast("long")
    seconds = (day * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return seconds * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _cut(frame: DataFrame) -> DataFrame:
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def next_pointers(moments: DataFrame, lifetime: int, width: int) -> DataFrame:
    """(k, us, nxt): the first moment of the same key later than us + lifetime, NULL if there is none. `moments` is (k, us), distinct."""
    asked = moments.select("k", (F.col("us") + lifetime).alias("at"), F.col("us").alias("asker"), F.lit(None).cast("long").alias("real"))
    there = moments.select("k", F.col("us").alias("at"), F.lit(None).cast("long").alias("asker"), F.col("us").alias("real"))
    both = there.unionByName(asked).withColumn("slice", F.floor(F.col("at") / width).cast("long"))
    # From late to early; one asked for at the very moment comes before it, as only later ones count.
    late = Window.partitionBy("k", "slice").orderBy(F.desc("at"), F.asc_nulls_last("asker"))
    near = both.withColumn("near", F.min("real").over(late.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    after = Window.partitionBy("k").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    later = both.groupBy("k", "slice").agg(F.min("real").alias("first")).select("k", "slice", F.min("first").over(after).alias("later"))
    return near.where(F.col("asker").isNotNull()).join(later, ["k", "slice"]).select(
        "k", F.col("asker").alias("us"), F.coalesce("near", "later").alias("nxt"))


def acceptances(rows: DataFrame, lifetime: int) -> DataFrame:
    """(k, us) of every acceptance; `rows` is (k, us), and repeated moments count once."""
    low, high, n = rows.agg(F.min("us"), F.max("us"), F.count(F.lit(1))).first()
    found = rows.groupBy("k").agg(F.min("us").alias("us"))
    if not n:
        return found
    width = max(1, (high - low) // max(1, min(MOST_SLICES, n // SLICE_ROWS)))
    level = _cut(next_pointers(rows.distinct(), lifetime, width).where("nxt IS NOT NULL"))
    levels = [level]
    for _ in range(((high - low) // max(1, lifetime) + 1).bit_length() - 1):
        level = _cut(level.join(level.select("k", F.col("us").alias("nxt"), F.col("nxt").alias("far")), ["k", "nxt"]).select(
            "k", "us", F.col("far").alias("nxt")))
        levels.append(level)
    for level in reversed(levels):
        found = _cut(found.unionByName(found.join(level, ["k", "us"]).select("k", F.col("nxt").alias("us"))))
    return found


def admit(requests: DataFrame, lifetime: dt.timedelta) -> DataFrame:
    """requests: tenant, key, event_id, ts, fingerprint -> (tenant, key, event_id, ts, outcome, accepted_event), as the fold has it.

    An acceptance governs what comes within its lifetime, so it is in the same or the one before of the spans of that length; a span
    holds one acceptance at most. NULL tenants and keys are a key like any other; at equal times the smaller event is accepted.
    """
    span = lifetime // dt.timedelta(microseconds=1)
    rows = requests.withColumn("k", F.struct("tenant", "key")).withColumn("us", instant(requests, "ts"))
    found = acceptances(rows.select("k", "us"), span).withColumn("mark", F.lit(True))
    # Acceptances are few: one row per key and lifetime.
    first = rows.join(found, ["k", "us"], "left_semi").groupBy("k", "us").agg(
        F.min_by(F.struct("event_id", "fingerprint"), "event_id").alias("a"))
    governs = first.withColumn("d", F.floor(F.col("us") / span).cast("long")).select(
        F.explode(F.array(F.col("d"), F.col("d") + 1)).alias("d"), "k", F.struct("us", "a.event_id", "a.fingerprint").alias("one"))
    held = governs.groupBy(F.struct("k", "d").alias("kd")).agg(F.sort_array(F.collect_list("one"), asc=False).alias("ones"))  # two at most
    placed = rows.withColumn("kd", F.struct("k", F.floor(F.col("us") / span).cast("long").alias("d")))
    by = F.element_at(F.filter("ones", lambda o: o["us"] <= F.col("us")), 1)
    judged = salted_left_join(placed, held, "kd", ["event_id"]).withColumn("by", by)
    outcome = F.when(F.col("by.event_id") == F.col("event_id"), "accepted").when(
        F.col("by.fingerprint").eqNullSafe(F.col("fingerprint")), "replay").otherwise("conflict")
    return judged.select("tenant", "key", "event_id", F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"),
                         F.col("by.event_id").cast("bigint").alias("accepted_event"))
