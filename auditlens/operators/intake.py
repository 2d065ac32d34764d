"""Order-dependent admission of requests, metrics, and the hook for a caller's model.

Whether a request is let in depends on which requests before it were: a fold per key, which streams through sorted partitions
with a small state. Requests of keys too busy for one task are judged by pointers instead (`busy_keys`).
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.functions.rows import salted_left_join, sized
from auditlens.operators import busy_keys

# --- fixed values: windows, limits and histogram edges ---
IDEMPOTENCY_TTL = dt.timedelta(hours=24)
RATE_LIMIT, RATE_WINDOW_S = 120, 60.0
LATENCY_EDGES = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
SCORER_BATCH = 8
# --- end of fixed values ---
#: Requests of a key that one task still folds; the result is the same either way.
BUSY_KEY = 1_000_000

INTAKE_SCHEMA = "tenant string, key string, event_id bigint, ts timestamp, outcome string, accepted_event bigint"
RATE_SCHEMA = "identity string, event_id bigint, ts timestamp, allowed boolean, remaining int, retry_after_us bigint"


class IdempotencyFold:
    """State of one key: when it was accepted, by which request, with which fingerprint."""

    def __init__(self) -> None:
        self.accepted: tuple[int, int, str] | None = None

    def step(self, us: int, event_id: int, fingerprint: str) -> tuple[str, int]:
        ttl = IDEMPOTENCY_TTL // dt.timedelta(microseconds=1)
        if self.accepted is None or self.accepted[0] + ttl < us:
            self.accepted = (us, event_id, fingerprint)
            return "accepted", event_id
        return ("replay" if self.accepted[2] == fingerprint else "conflict"), self.accepted[1]


class Admitted:
    """Admission times of one identity in order. A hit is let in while fewer than `limit` of them lie within the window before it."""

    TRIM = 4096

    def __init__(self, limit: int, window_s: float, times: Iterable[int] = ()) -> None:
        self.limit, self.window, self.times = limit, round(window_s * 1_000_000), list(times)

    def judge(self, hits: list[int]) -> tuple[list[bool], list[int], list[int]]:
        """(allowed, remaining, microseconds until the next is let in) for hits in order; no limit at all for one of 0 or less."""
        if self.limit <= 0:
            return [True] * len(hits), [-1] * len(hits), [0] * len(hits)
        allowed, remaining, wait = [], [], []
        for us in hits:
            free = self.limit - (len(self.times) - bisect_right(self.times, us - self.window))
            allowed.append(free > 0)
            remaining.append(max(free - 1, 0))
            wait.append(0 if free > 0 else max(0, self.times[-self.limit] + self.window - us))
            if free > 0:
                self.times.append(us)
                if len(self.times) > self.limit + self.TRIM:
                    del self.times[:-self.limit]
        return allowed, remaining, wait

    def recent(self) -> list[int]:
        return self.times[-self.limit:] if self.limit > 0 else []


def micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def quiet_runs(rows: DataFrame, keys: list[str], gap: dt.timedelta) -> DataFrame:
    """Rows with `run`, which goes up after every pause longer than `gap`: nothing from before one counts after it.

    Runs of a key are folded in parallel; only a key that never pauses stays one serial run.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    pause = F.col("ts") > F.lag("ts").over(order) + F.make_dt_interval(secs=F.lit(gap.total_seconds()).cast("decimal(18,6)"))
    marked = rows.withColumn("_new", F.coalesce(pause, F.lit(False)).cast("int"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("run", F.sum("_new").over(upto)).drop("_new")


def idempotent_intake(requests: DataFrame, busy: int = BUSY_KEY) -> DataFrame:
    """requests: tenant, key, event_id, ts, fingerprint -> accepted, replay or conflict for each.

    Keys of up to `busy` requests are folded, a key in a task; a busier one is spread over tasks by `busy_keys`.
    """
    asked = requests.select("tenant", "key", "event_id", "ts", "fingerprint")
    heavy = asked.groupBy(F.struct("tenant", "key").alias("k")).count().where(F.col("count") > busy).select("k")
    if heavy.isEmpty():
        return _folded(asked)
    heavy, keyed = sized(heavy), asked.withColumn("k", F.struct("tenant", "key"))
    rest = keyed.join(heavy, "k", "left_anti").drop("k")
    return _folded(rest).unionByName(busy_keys.admit(keyed.join(heavy, "k", "left_semi").drop("k"), IDEMPOTENCY_TTL))


def _folded(requests: DataFrame) -> DataFrame:
    ready = requests.repartition("tenant", "key").sortWithinPartitions("tenant", "key", "ts", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, IdempotencyFold()
        for pdf in batches:
            out = []
            for key, us, event, fp in zip(zip(pdf["tenant"], pdf["key"]), micros(pdf["ts"]), pdf["event_id"], pdf["fingerprint"]):
                if key != current:
                    current, state = key, IdempotencyFold()
                out.append(state.step(us, event, fp))
            yield pdf[["tenant", "key", "event_id", "ts"]].assign(
                outcome=[o for o, _ in out], accepted_event=pd.Series([e for _, e in out], dtype="int64"))

    return ready.mapInPandas(fold, INTAKE_SCHEMA)


def rate_admission(hits: DataFrame, limit: int = RATE_LIMIT, window_s: float = RATE_WINDOW_S) -> DataFrame:
    """hits: identity, event_id, ts. Only admitted hits count against the limit."""
    runs = quiet_runs(hits.select("identity", "event_id", "ts"), ["identity"], dt.timedelta(seconds=window_s))
    ready = runs.repartition("identity", "run").sortWithinPartitions("identity", "run", "ts", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, Admitted(limit, window_s)
        for pdf in batches:
            allowed, remaining, wait = [], [], []
            for key, part in pdf.groupby(["identity", "run"], sort=False, dropna=False):
                if key != current:
                    current, held = key, Admitted(limit, window_s)
                for column, values in zip((allowed, remaining, wait), held.judge(micros(part["ts"]))):
                    column += values
            yield pdf[["identity", "event_id", "ts"]].assign(
                allowed=allowed, remaining=pd.Series(remaining, dtype="int32"), retry_after_us=pd.Series(wait, dtype="int64"))

    return ready.mapInPandas(fold, RATE_SCHEMA)


# --- metrics -------------------------------------------------------------------


def histogram_columns(value: Column, edges: tuple[float, ...] = LATENCY_EDGES) -> list[Column]:
    return [F.count(F.when(value <= e, 1)).alias(f"le_{i}") for i, e in enumerate(edges)] + [
        F.count(value).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("avg")]


def unfold_histogram(sums: DataFrame, by: list[str], edges: tuple[float, ...] = LATENCY_EDGES) -> DataFrame:
    """(labels, edge, cumulative, sum, count, avg); the last edge is '+Inf'."""
    entries = [F.struct(F.lit(f"{e:g}").alias("edge"), F.col(f"le_{i}").alias("cumulative")) for i, e in enumerate(edges)]
    entries.append(F.struct(F.lit("+Inf").alias("edge"), F.col("count").alias("cumulative")))
    return sums.select(*by, F.inline(F.array(*entries)), "sum", "count", "avg")


def latency_histogram(observations: DataFrame, by: list[str], edges: tuple[float, ...] = LATENCY_EDGES) -> DataFrame:
    return unfold_histogram(observations.groupBy(*by).agg(*histogram_columns(F.col("value"), edges)), by, edges)


def counters(increments: DataFrame, by: list[str]) -> DataFrame:
    return increments.groupBy(*by).agg(F.sum("by").alias("value"))


def gauges(readings: DataFrame, by: list[str]) -> DataFrame:
    """Last reading; equal times go to the later event."""
    return readings.groupBy(*by).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


# --- model hook -------------------------------------------------------------------

VERDICT_SCHEMA = ("tenant string, claim_id string, line_no bigint, classification string, cited_chunk_id string, "
                  "reason string, confidence double, error string")
_FIELDS = ["classification", "cited_chunk_id", "reason", "confidence"]
_COLUMNS = pd.Index(_FIELDS, dtype=object)


def stub_model(batch: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: the first candidate decides when the line is under OTHER."""
    rows = np.empty((len(batch), len(_FIELDS)), dtype=object)
    for i, (found, head) in enumerate(zip(batch["candidates"].tolist(), batch["head"].tolist())):
        first = found[0] if found is not None and len(found) else None
        listed = first is not None and head == "OTHER" and str(first["tag"]).startswith("LIST_")
        rows[i] = (first["tag"] if listed else "PAYABLE", first["doc_id"] if listed else None, "first candidate", 1.0)
    return pd.DataFrame(rows, columns=_COLUMNS, index=batch.index, dtype=object)  # given the type, nothing is guessed per call


def model_scorer(lines: DataFrame, candidates: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] = stub_model,
                 batch_size: int = SCORER_BATCH) -> DataFrame:
    """Verdict table from a caller's model, asked for `batch_size` lines at a time.

    `candidates` is (text, candidates). A batch the model fails on comes back with its error instead of verdicts. The candidates of a
    description are made Python objects once per Arrow batch, and its lines share them.
    """
    keyed = lines.select("tenant", "claim_id", "line_no", "head", "description", F.lower("description").alias("text"))
    asked = salted_left_join(keyed, sized(candidates), "text", ["claim_id", "line_no"]).drop("text")

    def shared(rows: pa.RecordBatch) -> np.ndarray:
        codes = rows.column("description").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        _, first, place = np.unique(codes, return_index=True, return_inverse=True)
        found = np.empty(len(first), dtype=object)
        found[:] = rows.column("candidates").take(pa.array(first)).to_pylist()
        return found[place]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            pdf = rows.select(["tenant", "claim_id", "line_no", "head", "description"]).to_pandas()
            pdf["candidates"] = shared(rows)
            answers, errors = [], []
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at:at + batch_size]
                try:
                    reply = model(part)
                    got, error = (reply if reply.columns.equals(_COLUMNS) else reply[_FIELDS]).to_numpy(dtype=object), None
                except Exception as exc:  # noqa: BLE001 - one failed call must not stop the audit
                    got, error = np.full((len(part), len(_FIELDS)), None, dtype=object), type(exc).__name__
                answers.append(got)
                errors += [error] * len(part)
            answered = pd.DataFrame(np.concatenate([np.empty((0, len(_FIELDS)), dtype=object), *answers]), columns=_COLUMNS)
            answered["confidence"] = answered["confidence"].astype(float)
            columns = [rows.column(k).cast(t) for k, t in (("tenant", pa.string()), ("claim_id", pa.string()), ("line_no", pa.int64()))]
            columns += [pa.array(answered[f], pa.float64() if f == "confidence" else pa.string(), from_pandas=True) for f in _FIELDS]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], names=["tenant", "claim_id", "line_no", *_FIELDS, "error"])

    return asked.mapInArrow(score, VERDICT_SCHEMA)
