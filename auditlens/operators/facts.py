"""One wide row of measures per claim: what waterfall, checklist, checks and verdict all read.

Everything is a sum, a count or a boolean, so Spark combines map-side and a claim of any number of lines
costs one row per partition in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.vocabulary import CLASSES, HEADS, SEVERITIES, is_listed
from auditlens.operators.documents import attached_bits

KEYS = ["tenant", "claim_id"]

# --- fixed values: thresholds that decide results ---
READ_CONFIDENCE = 0.7
ROUND_FLOOR_PAISE = 100_000
# --- end of fixed values ---


def _sum(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("bigint")


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1)).cast("bigint")


def measures() -> list[Column]:
    amount, deducted, cls = F.col("amount_paise"), F.col("deducted_paise"), F.col("classification")
    unmapped = cls == "UNMAPPED"
    unsure = (F.col("extract_confidence") < READ_CONFIDENCE) & ~unmapped
    outside = F.col("outside_stay")
    big = amount >= ROUND_FLOOR_PAISE
    listed = is_listed(cls)
    return [
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("gross_paise"),
        _sum(F.col("bearer") == "PATIENT", deducted).alias("patient_items"),
        _sum(F.col("bearer") == "HOSPITAL", deducted).alias("hospital_items"),
        *[_sum(F.col("head") == h, amount - deducted).alias(f"payable_{h.lower()}") for h in HEADS],
        *[_count(F.col("head") == h).alias(f"lines_{h.lower()}") for h in ("ROOM", "PROCEDURE", "INVESTIGATION", "PHARMACY", "IMPLANT")],
        *[_count(cls == c).alias(f"n_{c.lower()}") for c in CLASSES],
        *[_count((cls != "PAYABLE") & (F.col("severity") == s)).alias(f"items_{s.lower()}") for s in SEVERITIES],
        _sum(F.col("head") == "ROOM", amount).alias("room_billed"),
        _count(outside).alias("n_outside"), _sum(F.col("outside_number"), amount).alias("outside_paise"),
        _count(F.lower("description").contains("icu")).alias("n_icu_named"),
        _sum(unmapped, amount).alias("unmapped_paise"),
        _count(unsure).alias("n_unsure"), _sum(unsure, amount).alias("unsure_paise"),
        _count(big).alias("n_big"), _count(big & (amount % ROUND_FLOOR_PAISE == 0)).alias("n_round"),
        _count(listed & (F.coalesce("cited_chunk_id", F.lit("")) == "")).alias("n_uncited"),
        _count(F.col("source") == "llm").alias("n_llm"),
        _count(amount < 0).alias("n_credit"),
    ]


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Groups of equal (description, amount, date) within a claim. Missing dates are equal to each other."""
    return (
        lines.groupBy(*KEYS, tx.item_key(F.col("description")).alias("item"), "amount_paise", "service_date")
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def claim_facts(findings: DataFrame) -> DataFrame:
    repeats = repeated_lines(findings).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_repeated"), F.sum(F.col("amount_paise") * (F.col("n") - 1)).cast("bigint").alias("repeated_paise"))
    return findings.groupBy(*KEYS).agg(*measures()).join(repeats, KEYS, "left")


def with_facts(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """Claim headers with their measures; a claim without lines has zeros. The list of documents gives way to `attached`, see `attached_bits`,
    before the join: it is the longest part of a header."""
    claims = claims.withColumn("attached", attached_bits()).drop("documents") if "documents" in claims.columns else claims
    joined = claims.join(claim_facts(findings), KEYS, "left")
    known = set(claims.columns)
    return joined.select(*[c if c in known else F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in joined.columns])
