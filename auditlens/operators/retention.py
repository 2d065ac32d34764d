"""Retention windows and erasure, over frames of the store and over its files. Tables are rewritten by anti-join, never row by row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.operators import ledger
from auditlens.sources.store import KEYS, Store, erase, read_store

# --- fixed values: retention windows ---
CLAIM_DAYS, TRACE_DAYS = 730, 90
# --- end of fixed values ---


def expired_claims(claims: DataFrame, today: dt.date, days: int = CLAIM_DAYS, tenant: str | None = None) -> DataFrame:
    """Keys of claims audited before the cutoff day."""
    rows = claims.where(F.col("audited_at") < F.to_timestamp(F.lit((today - dt.timedelta(days=days)).isoformat())))
    return (rows if tenant is None else rows.where(F.col("tenant") == tenant)).select(*KEYS)


def expired_traces(traces: DataFrame, today: dt.date, days: int = TRACE_DAYS, tenant: str | None = None) -> DataFrame:
    rows = traces.where(F.col("written_at") < F.to_timestamp(F.lit((today - dt.timedelta(days=days)).isoformat())))
    return rows if tenant is None else rows.where(F.col("tenant") == tenant)


def purge_report(store: Store, today: dt.date, days: int = CLAIM_DAYS, tenant: str | None = None, traces: DataFrame | None = None,
                 trace_days: int = TRACE_DAYS, dry_run: bool = True) -> DataFrame:
    """One row: what a purge removes. The counts are the true ones in a dry run too."""
    gone = expired_claims(store.claims, today, days, tenant)
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    n_traces = F.lit(0).cast("bigint") if traces is None else count(expired_traces(traces, today, trace_days, tenant))
    return gone.agg(F.count(F.lit(1)).alias("claims_deleted")).select(
        "claims_deleted", count(store.findings.join(gone, KEYS, "left_semi")).alias("findings_deleted"),
        count(store.doc_gaps.join(gone, KEYS, "left_semi")).alias("gaps_deleted"), n_traces.alias("traces_deleted"),
        F.lit((today - dt.timedelta(days=days)).isoformat()).alias("cutoff"), F.lit(dry_run).alias("dry_run"))


def without(store: Store, gone: DataFrame) -> Store:
    """The store without the given claims; children go with their parents."""
    keys = gone.select(*KEYS)
    return Store(*[t.join(keys, KEYS, "left_anti") for t in (store.claims, store.findings, store.doc_gaps)])


def purge_expired(store: Store, today: dt.date, days: int = CLAIM_DAYS, tenant: str | None = None) -> Store:
    return without(store, expired_claims(store.claims, today, days, tenant))


def erase_claims(store: Store, requests: DataFrame, recorded_at: Column, batch: str, reason: str = "erasure request") -> tuple[Store, DataFrame]:
    """(store without the requested claims, chained tombstones of those that existed).

    The ledger keeps its entries: it gains one that says the record is gone.
    """
    known = requests.select(*KEYS).distinct().join(store.claims, KEYS, "left_semi")
    return without(store, known), ledger.chain_append(ledger.tombstones(known, recorded_at, reason), batch)


def purge_store(spark: SparkSession, path: str, today: dt.date, days: int = CLAIM_DAYS, tenant: str | None = None, dry_run: bool = True) -> DataFrame:
    """The report of a purge; unless it is a dry run, the expired claims are gone from the files afterwards."""
    store = read_store(spark, path)
    report = spark.createDataFrame(purge_report(store, today, days, tenant, dry_run=dry_run).collect(), purge_report(store, today, days, tenant).schema)
    if not dry_run:
        erase(spark, path, expired_claims(store.claims, today, days, tenant))
    return report


def erase_from_store(spark: SparkSession, path: str, requests: DataFrame, recorded_at: Column, batch: str,
                     ledger_path: str, reason: str = "erasure request") -> DataFrame:
    """Erase claims from the files. Their chained tombstones are appended to the ledger's files first, and returned."""
    known = requests.select(*KEYS).distinct().join(read_store(spark, path).claims, KEYS, "left_semi")
    target = f"{ledger_path}/batch={batch}"
    ledger.chain_append(ledger.tombstones(known, recorded_at, reason), batch).write.mode("errorifexists").parquet(target)
    tombs = spark.read.parquet(target)
    erase(spark, path, tombs.select(*KEYS))
    return tombs
