"""Claims and bill lines derived from an order/lineitem warehouse (the rules are in FIXTURES.md).

Only projections and two equi-joins: nothing is numbered, sorted or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions import text as tx

# --- fixed values: the description and head of every kind of bill line ---
VOCAB = (
    ("Room rent twin bed", "ROOM"), ("Deluxe bed tariff", "ROOM"), ("ICU bed tariff", "ROOM"),
    ("Ward nursing", "NURSING"), ("Special nursing", "NURSING"),
    ("Surgeon fee", "PROCEDURE"), ("Theatre charges", "PROCEDURE"),
    ("Anaesthesia fee", "PROCEDURE"), ("Physio session", "PROCEDURE"),
    ("Blood panel", "INVESTIGATION"), ("MRI knee", "INVESTIGATION"),
    ("Shoulder blade x-ray", "INVESTIGATION"), ("Chest scan", "INVESTIGATION"),
    ("Cap amoxicillin 500", "PHARMACY"), ("Saline 500 ml", "PHARMACY"),
    ("Antibiotic vial", "PHARMACY"), ("Soap enema solution", "PHARMACY"),
    ("Consultant round", "CONSULTATION"), ("Dietician review", "CONSULTATION"),
    ("Knee prosthesis", "IMPLANT"), ("Bone plate", "IMPLANT"),
    ("Visitor meals x2", "OTHER"), ("Telephone usage", "OTHER"), ("TV hire / day", "OTHER"),
    ("LAUNDRY", "OTHER"), ("  Patient Gown ", "OTHER"), ("Disposable cap", "OTHER"),
    ("Housekeeping fee", "OTHER"), ("Bed pan steel", "OTHER"), ("Sterile gloves 7.5", "OTHER"),
    ("Drape sheet", "OTHER"), ("Surgical blade 15", "OTHER"), ("Gauze roll", "OTHER"),
    ("Sterilisation fee", "OTHER"), ("Registration fee", "OTHER"), ("Medical records fee", "OTHER"),
    ("Capsule strip", "OTHER"), ("Misc chg 4471", "OTHER"), ("Sundry", "OTHER"), ("Urine bag", "OTHER"),
)
CHECKLIST_IDS = (
    "DOC-CLAIM-FORM", "DOC-DISCHARGE-SUMMARY", "DOC-FINAL-BILL", "DOC-MLC", "DOC-IMPLANT-INV",
    "DOC-PED-HISTORY", "DOC-INDOOR-PAPERS", "DOC-INVESTIGATION-REPORTS", "DOC-OT-NOTES",
    "DOC-PHARMACY-BILLS", "DOC-PREAUTH-ENHANCEMENT", "DOC-ID-PROOF",
)
# --- end of fixed values ---

REPEAT_OFFSET = 100_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _owned_orders(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(k, owner, admission_date) and `more` columns of the orders that have a customer. What follows from the key is made by `_named`, after the
    joins: a join moves narrow rows."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", F.to_date("o_orderdate").alias("admission_date"), *more)
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 4).cast("tinyint").alias("owner"))
    return orders.join(customer, "o_custkey").drop("o_custkey")


def _named(rows: DataFrame) -> DataFrame:
    k = F.col("k")
    return rows.withColumns({
        "tenant": F.concat(F.lit("T"), F.col("owner").cast("string")),
        "claim_id": F.concat(F.lit("CLM-"), k.cast("string")),
        "discharge_date": F.date_add("admission_date", (k % 9).cast("int")),
        "rate": ((F.lit(2000) + F.lit(500) * (k % 20)) * 100).cast("bigint"),
    }).drop("owner")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    room_cap = F.when(k % 6 != 5, (F.lit(4000) + F.lit(1000) * (k % 5)) * 100)
    si = (F.lit(3) + k % 8) * 100_000 * 100
    sub = "array<struct<name:string,limit_paise:bigint>>"

    def limits(*pairs: tuple[str, int]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).cast("bigint").alias("limit_paise")) for n, v in pairs]).cast(sub)

    docs = F.array_compact(F.array(*[
        F.when((k * 7 + 13 * n) % 10 < 7, F.lit(d)) for n, d in enumerate(CHECKLIST_IDS)]))
    orders = _owned_orders(
        spark, sf_dir, F.col("o_orderpriority").alias("diagnosis"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price"))
    return _named(orders).select(
        "tenant", "claim_id",
        F.when(k % 3 == 0, "reimbursement").otherwise("cashless").alias("claim_type"),
        "admission_date", "discharge_date", "diagnosis",
        F.when(k % 4 == 0, "Total knee replacement").when(k % 4 == 1, "Coronary artery bypass graft")
        .when(k % 4 == 2, "Lens implant").alias("procedure"),
        (k % 7 == 0).alias("is_accident"), F.lit(False).alias("is_maternity"),
        (k % 10 == 3).alias("involves_implant"), (k % 6 == 1).alias("is_ped_related"),
        F.when(k % 5 != 0, F.expr("(price * (4 + k % 5)) div 10")).cast("bigint").alias("preauth_paise"),
        docs.alias("documents"),
        F.concat(F.lit("POL-"), (k % 1000).cast("string")).alias("policy_id"),
        si.cast("bigint").alias("sum_insured_paise"),
        (si - (k % 3) * 50_000 * 100).cast("bigint").alias("balance_paise"),
        room_cap.cast("bigint").alias("room_cap_paise"), (room_cap * 2).cast("bigint").alias("icu_cap_paise"),
        F.when((k % 6).isin(3, 4), 10).when(k % 6 == 5, 20).otherwise(0).cast("decimal(9,2)").alias("copay_pct"),
        F.when(k % 8 == 0, 500_000).otherwise(0).cast("bigint").alias("deductible_paise"),
        F.when(k % 4 == 0, limits(("knee replacement", 12_000_000)))
        .when(k % 4 == 1, limits(("bypass", 15_000_000), ("graft", 9_000_000)))
        .otherwise(F.array().cast(sub)).alias("sublimits"),
        F.when(k % 11 == 0, "ICU").otherwise("Ward").alias("room_category"),
        F.col("rate").cast("decimal(24,6)").alias("rate_paise"),
        (F.greatest(k % 9, F.lit(1)) + F.when(k % 13 == 0, 2).otherwise(0)).cast("int").alias("room_days"),
        (k % 11 == 0).alias("is_icu"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Price and readability in one number: readers of one or the other move the same rows, so that a plan with both moves them once.
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey", "l_linenumber",
        (cents * 2 + F.coalesce((F.col("l_discount") < 0.01).cast("bigint"), F.lit(0))).alias("packed"))
    part, number = F.col("l_partkey"), F.col("l_linenumber")
    vocab = F.array(*[F.struct(F.lit(d).alias("description"), F.lit(h).alias("head")) for d, h in VOCAB])
    entry = F.element_at(vocab, (part % len(VOCAB) + 1).cast("int"))
    base = (
        F.when(F.col("head") == "ROOM", F.col("rate") * F.col("qty"))
        .when(F.col("head") == "OTHER", F.expr("price div 25"))
        .otherwise(F.col("price"))
    )
    rows = (
        _named(items.join(_owned_orders(spark, sf_dir), "k"))
        .withColumns({"price": F.shiftright("packed", 1), "blurred": F.col("packed").bitwiseAND(F.lit(1)) == 1})
        .withColumn("entry", entry)
        .withColumns({"description": F.col("entry.description"), "head": F.col("entry.head")})
        .withColumn("qty", F.when(F.col("head") == "ROOM", F.lit(1) + number % 3).otherwise(F.lit(1)).cast("bigint"))
        .withColumn("base", base)
        .withColumn("service_date", F.when(part % 5 != 0, F.date_add("admission_date", ((part + number) % 12).cast("int"))))
    )
    own = (number.cast("bigint") * 1_000_000_000 + part) * 1000 + F.col("l_suppkey") % 1000
    repeats = F.when((F.col("k") % 17 == 0) & (number == 1), F.array(F.lit(0).cast("bigint"), F.lit(REPEAT_OFFSET).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return rows.withColumn("shift", F.explode(repeats)).select(
        "tenant", "claim_id", (own + F.col("shift")).cast("bigint").alias("line_no"), "description", "head",
        F.col("qty").cast("decimal(18,2)").alias("quantity"),
        F.when((F.col("head") == "ROOM") & (part % 3 != 0), F.col("rate")).otherwise(0).cast("bigint").alias("unit_rate_paise"),
        F.when(part % 97 == 0, -F.col("base")).when(F.col("k") % 29 == 0, F.expr("(base div 100000) * 100000"))
        .otherwise(F.col("base")).cast("bigint").alias("amount_paise"),
        "service_date",
        F.when(F.col("blurred"), 0.5).otherwise(0.95).alias("extract_confidence"),
        F.coalesce(~F.col("service_date").between(F.col("admission_date"), F.col("discharge_date")), F.lit(False)).alias("outside_stay"),
    )


def letter_vector(x: Column) -> Column:
    """26 letter counts of a text: a stand-in for an embedding that any SQL engine can repeat."""
    low = F.lower(x)
    return F.array(*[
        (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])
