"""Streaming twins of the admission folds: the same folds, their state kept by Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlens.operators.intake import (
    IDEMPOTENCY_TTL, INTAKE_SCHEMA, RATE_LIMIT, RATE_SCHEMA, RATE_WINDOW_S, Admitted, IdempotencyFold, micros,
)

#: Keys share the state of a slot: Spark's call of a fold costs far more than judging the few requests of one key. A checkpoint keeps
#: its number of slots.
SLOTS = 1024
_OUT = ["tenant", "key", "event_id", "ts", "outcome", "accepted_event"]


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one group in one trigger, in event order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")


def idempotent_stream(requests: DataFrame, lateness: str = "10 minutes", slots: int = SLOTS) -> DataFrame:
    """accepted, replay or conflict per request. A key is forgotten once the watermark is a day past its acceptance."""
    ttl_us = IDEMPOTENCY_TTL // dt.timedelta(microseconds=1)

    def fold(slot: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[tuple[Any, ...], IdempotencyFold] = {}
        if state.exists:
            for tenant, key, *accepted in zip(*state.get):
                held[tenant, key] = one = IdempotencyFold()
                one.accepted = tuple(accepted)
        if not state.hasTimedOut:
            rows = _ordered(batches)
            out = [held.setdefault(key, IdempotencyFold()).step(us, e, fp)
                   for key, us, e, fp in zip(zip(rows["tenant"], rows["key"]), micros(rows["ts"]), rows["event_id"], rows["fingerprint"])]
            yield rows.assign(outcome=[o for o, _ in out], accepted_event=pd.Series([e for _, e in out], index=rows.index, dtype="int64"))[_OUT]
        now = state.getCurrentWatermarkMs()
        kept = [(*key, *one.accepted) for key, one in held.items() if (one.accepted[0] + ttl_us) // 1000 + 1 > now]
        if kept:
            state.update(tuple(list(column) for column in zip(*kept)))
            state.setTimeoutTimestamp((min(accepted for _, _, accepted, *_ in kept) + ttl_us) // 1000 + 1)
        elif state.exists:
            state.remove()

    slotted = requests.withWatermark("ts", lateness).withColumn("slot", F.pmod(F.xxhash64("tenant", "key"), F.lit(slots)))
    return slotted.groupBy("slot").applyInPandasWithState(
        fold, INTAKE_SCHEMA, "tenant array<string>, key array<string>, us array<bigint>, event_id array<bigint>, fingerprint array<string>",
        "append", GroupStateTimeout.EventTimeTimeout)


def distinct_requests(requests: DataFrame, window: str = "24 hours") -> DataFrame:
    """When only repeats have to go: the first of equal (tenant, key) within the window."""
    return requests.withWatermark("ts", window).dropDuplicatesWithinWatermark(["tenant", "key"])


def rate_stream(hits: DataFrame, limit: int = RATE_LIMIT, window_s: float = RATE_WINDOW_S, lateness: str = "10 minutes") -> DataFrame:
    """Sliding-window admission; the state of an identity is the times it was let in at, forgotten a window after the last hit."""

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = Admitted(limit, window_s, state.get[0] if state.exists else ())
        rows = _ordered(batches)
        times = micros(rows["ts"])
        allowed, remaining, wait = held.judge(times)
        state.update((held.recent(),))
        expiry_ms = max([*held.recent(), *times]) // 1000 + int(window_s * 1000) + 1
        state.setTimeoutTimestamp(max(expiry_ms, state.getCurrentWatermarkMs() + 1))
        yield rows[["identity", "event_id", "ts"]].assign(
            allowed=allowed, remaining=pd.Series(remaining, index=rows.index, dtype="int32"),
            retry_after_us=pd.Series(wait, index=rows.index, dtype="int64"))

    return hits.withWatermark("ts", lateness).groupBy("identity").applyInPandasWithState(
        fold, RATE_SCHEMA, "hits array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
