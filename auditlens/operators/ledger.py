"""A tamper-evident record of every determination.

Entries are chained by SHA-256. One chain per tenant would be a serial job, so a tenant's entries of a batch
are split over chains of bounded expected length by the hash of their content: appending and verifying run
chain by chain in parallel, and no tenant's history has to fit in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.functions.hashing import canonical_json, lane_numbers, lane_sum, sha256_text
from auditlens.functions.money import from_paise
from auditlens.functions.rows import salted_left_join
from auditlens.operators.facts import KEYS

# --- fixed values: genesis and the fields an entry hash covers, in order ---
GENESIS = "0" * 64
CHAINED = (
    "recorded_at", "tenant", "key_id", "claim_id", "packet_digest", "corpus_version",
    "strategy", "verdict", "gross_paise", "settlement_paise", "patient_paise",
    "hospital_paise", "finding_counts", "verify_passed", "prev_hash",
)
HISTORY_PAGE = 100
# --- end of fixed values ---

CHAIN_LENGTH = 256
PREV_REASON = "prev_hash does not match the entry before: an entry was removed or moved"
HASH_REASON = "entry_hash does not match the content: the entry was changed afterwards"
MISSING_REASON = "the chain is listed but has no entries"
UNLISTED_REASON = "the chain has entries but is not listed"
SHORT_REASON = "the chain ends before its listed end"
HEAD_REASON = "the chain ends with another entry than listed"


def packet_digest(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """(tenant, claim_id, packet_digest): content hash of a packet, independent of the order of its lines."""
    header = canonical_json(**{c: F.col(c) for c in claims.columns})
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(set(lines.columns) - set(KEYS))])
    hashed = lines.select(*KEYS, sha256_text(line).alias("_h"))  # a line is hashed once for all lanes
    lanes = lane_numbers(F.col("_h"))
    numbered = hashed.select(*KEYS, *[n.alias(f"s{i}") for i, n in enumerate(lanes)])
    sums = numbered.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *[lane_sum(F.col(f"s{i}")).alias(f"s{i}") for i in range(len(lanes))])
    body = F.concat_ws("|", F.coalesce("n", F.lit(0)).cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(len(lanes))])
    return claims.withColumn("_header", header).select(*KEYS, "_header").join(sums, KEYS, "left").select(
        *KEYS, sha256_text(F.concat_ws("#", "_header", body)).alias("packet_digest"))


def finding_counts_json(counts: Column) -> Column:
    """Classification -> count with sorted keys, classes without findings left out."""
    names = ("LIST_III_PROCEDURE", "LIST_II_ROOM", "LIST_IV_TREATMENT", "LIST_I_OPTIONAL", "PAYABLE", "UNMAPPED")
    present = F.array_compact(F.array(*[F.when(counts[n] > 0, F.concat(F.lit(f'"{n}":'), counts[n].cast("string"))) for n in names]))
    return F.concat(F.lit("{"), F.array_join(present, ","), F.lit("}"))


def ledger_rows(audits: DataFrame, digests: DataFrame, recorded_at: Column, key_id: str = "anonymous", request_id: str = "") -> DataFrame:
    """One unchained entry per audit."""
    return audits.join(digests, KEYS).select(
        recorded_at.alias("recorded_at"), "tenant", F.lit(key_id).alias("key_id"), F.lit(request_id).alias("request_id"), "claim_id",
        "packet_digest", "corpus_version", "strategy", "verdict", "gross_paise", "settlement_paise", "patient_paise", "hospital_paise",
        finding_counts_json(F.col("class_counts")).alias("finding_counts"), F.col("verify_passed").cast("int").alias("verify_passed"))


def content(prev: Column) -> Column:
    return F.concat_ws("|", *[prev if f == "prev_hash" else F.col(f).cast("string") for f in CHAINED])


def assign_chains(rows: DataFrame, batch: str, chain_length: int = CHAIN_LENGTH) -> DataFrame:
    """Adds chain and seq. The number of chains of a tenant follows its count, the chain of an entry its hash."""
    per_tenant = rows.groupBy("tenant").agg(F.ceil(F.count(F.lit(1)) / F.lit(chain_length)).cast("bigint").alias("_chains"))
    h = sha256_text(F.concat_ws("|", *[F.col(f).cast("string") for f in CHAINED if f != "prev_hash"]))
    number = F.pmod(F.conv(F.substring(F.col("_h"), 1, 12), 16, 10).cast("bigint"), F.col("_chains"))
    # Few tenants hold most entries, so their rows are spread over salts unless the count table is broadcast.
    counted = salted_left_join(rows.withColumn("_h", h), per_tenant, "tenant", ["_h"], how="inner")
    chained = counted.withColumn(
        "chain", F.concat_ws("/", "tenant", F.lit(batch), number.cast("string")))
    order = Window.partitionBy("chain").orderBy("recorded_at", "claim_id", "_h")
    return chained.withColumn("seq", F.row_number().over(order)).drop("_chains", "_h")


def chain_append(rows: DataFrame, batch: str, chain_length: int = CHAIN_LENGTH) -> DataFrame:
    """Chained entries of a batch. Every batch opens chains of its own, so batches never wait for each other.

    A chain is a fold over a bounded, sorted array; the fold keeps (previous hash, hashes so far).
    """
    placed = assign_chains(rows, batch, chain_length)
    # The text around prev_hash is fixed per entry; prev_hash is the last chained field.
    stem = F.concat_ws("|", *[F.col(f).cast("string") for f in CHAINED if f != "prev_hash"])
    cols = [c for c in placed.columns if c != "chain"]
    start = F.struct(F.lit(GENESIS).alias("prev"), F.array().cast("array<string>").alias("hashes"))

    def step(state: Column, e: Column) -> Column:
        h = sha256_text(F.concat(e["stem"], F.lit("|"), state["prev"]))
        return F.struct(h.alias("prev"), F.concat(state["hashes"], F.array(h)).alias("hashes"))

    entry = F.struct(F.col("seq"), stem.alias("stem"), F.struct(*[c for c in cols if c != "seq"]).alias("row"))
    grouped = placed.groupBy("chain").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    hashed = grouped.select("chain", "entries", F.aggregate("entries", start, step, lambda s: s["hashes"]).alias("hashes"))
    # Zipped, every entry comes out with its own two hashes instead of a copy of all of its chain.
    before = F.concat(F.array(F.lit(GENESIS)), F.slice("hashes", F.lit(1), F.size("hashes") - 1))
    zipped = F.arrays_zip(F.col("entries").alias("e"), before.alias("prev_hash"), F.col("hashes").alias("entry_hash"))
    return hashed.select("chain", F.inline(zipped).alias("e", "prev_hash", "entry_hash")).select(
        "chain", "e.seq", "e.row.*", "prev_hash", "entry_hash")


def chain_append_long(rows: DataFrame, batch: str, chain_length: int = CHAIN_LENGTH) -> DataFrame:
    """The same chains, hashed in Arrow batches: sorted partitions stream through with one hash of state."""
    placed = assign_chains(rows, batch, chain_length)
    stem = F.concat_ws("|", *[F.col(f).cast("string") for f in CHAINED if f != "prev_hash"])
    ready = placed.withColumn("_stem", stem).repartition("chain").sortWithinPartitions("chain", "seq")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema) + ", prev_hash string, entry_hash string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, prev = None, GENESIS
        for pdf in batches:
            prevs, hashes = [], []
            for name, text in zip(pdf["chain"], pdf["_stem"]):
                if name != chain:
                    chain, prev = name, GENESIS
                prevs.append(prev)
                prev = hashlib.sha256(f"{text}|{prev}".encode()).hexdigest()
                hashes.append(prev)
            yield pdf.drop(columns="_stem").assign(prev_hash=prevs, entry_hash=hashes)

    return ready.mapInPandas(fold, schema)


def _judged(entries: DataFrame) -> DataFrame:
    """Entries with the reason why one breaks its chain, or NULL; every entry is judged on its own, in parallel."""
    expected = F.lag("entry_hash", 1, GENESIS).over(Window.partitionBy("chain").orderBy("seq"))
    recomputed = sha256_text(content(F.col("prev_hash")))
    return entries.withColumn("_expected", expected).select(
        "chain", "seq", F.when(F.col("prev_hash") != F.col("_expected"), PREV_REASON)
        .when(F.col("entry_hash") != recomputed, HASH_REASON).alias("reason"))


def verify_entries(entries: DataFrame) -> DataFrame:
    return _judged(entries).where("reason is not null")


def verify_chain(entries: DataFrame) -> DataFrame:
    """Per chain: entries, ok, and the first entry that does not hold with the reason. One pass over the entries."""
    broken = F.col("reason").isNotNull()
    return _judged(entries).groupBy("chain").agg(
        F.count(F.lit(1)).alias("entries"), F.min(F.when(broken, F.col("seq"))).alias("broken_at"),
        F.min_by(F.when(broken, F.col("reason")), F.when(broken, F.col("seq"))).alias("reason")).select(
        "chain", "entries", F.col("broken_at").isNull().alias("ok"), "broken_at", "reason")


def heads(entries: DataFrame) -> DataFrame:
    """Newest entry of every chain that has entries. `manifest` also knows of chains that should have some."""
    return entries.groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("head"))


def manifest(entries: DataFrame, batch: str) -> DataFrame:
    """One row per chain of a batch, kept apart from the entries: how many they are, and the hash of the last.

    A chain by itself cannot tell that its end, or all of it, is gone; together with the manifest it can.
    """
    return entries.groupBy("chain").agg(F.count(F.lit(1)).alias("entries"), F.max_by("entry_hash", "seq").alias("head")).select(
        F.lit(batch).alias("batch"), "chain", "entries", "head")


def verify_manifest(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """Chains that do not end as listed: missing as a whole, cut short, changed at the end, or not listed at all."""
    now = heads(entries).select("chain", F.col("seq").alias("_seq"), F.col("head").alias("_head"))
    both = listed.join(now, "chain", "full")
    return both.select("chain", F.when(F.col("_seq").isNull(), MISSING_REASON).when(F.col("entries").isNull(), UNLISTED_REASON)
                       .when(F.col("_seq") < F.col("entries"), SHORT_REASON).when(F.col("_head") != F.col("head"), HEAD_REASON).alias("reason")).where("reason is not null")


def history(entries: DataFrame, claim_id: str | None = None, tenant: str | None = None, limit: int = HISTORY_PAGE,
            after: tuple[str, str, int] | None = None) -> DataFrame:
    """A page of entries, newest first, in rupees. `after` is (recorded_at, chain, seq) of the last row of the page before."""
    rows = entries
    if claim_id:
        rows = rows.where(F.col("claim_id") == claim_id)
    if tenant:
        rows = rows.where(F.col("tenant") == tenant)
    if after is not None:
        at, chain, seq = (F.lit(v) for v in after)
        rows = rows.where((F.col("recorded_at") < at) | ((F.col("recorded_at") == at) & (
            (F.col("chain") < chain) | ((F.col("chain") == chain) & (F.col("seq") < seq)))))
    page = rows.orderBy(F.desc("recorded_at"), F.desc("chain"), F.desc("seq")).limit(max(1, limit))
    return page.select(
        "chain", "seq", "recorded_at", "tenant", "key_id", "claim_id", "verdict", "strategy", "finding_counts",
        *[from_paise(F.col(f"{n}_paise")).alias(n) for n in ("gross", "settlement", "patient", "hospital")],
        F.col("verify_passed").cast("boolean").alias("verify_passed"))


def tombstones(erased: DataFrame, recorded_at: Column, reason: str) -> DataFrame:
    """Unchained entries that say a claim was erased: same shape as any other, no money, no digest."""
    zero = F.lit(0).cast("bigint")
    return erased.select(
        recorded_at.alias("recorded_at"), "tenant", F.lit("retention").alias("key_id"), F.lit("").alias("request_id"), "claim_id",
        F.lit("").alias("packet_digest"), F.lit("").alias("corpus_version"), F.lit("erasure").alias("strategy"), F.lit("ERASED").alias("verdict"),
        zero.alias("gross_paise"), zero.alias("settlement_paise"), zero.alias("patient_paise"), zero.alias("hospital_paise"),
        F.to_json(F.struct(F.lit(reason).alias("reason"))).alias("finding_counts"), F.lit(1).alias("verify_passed"))
