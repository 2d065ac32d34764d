"""Aggregates over stored audits: totals, leakage, recovery, catalogue and trace summaries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.money import div_half_even, from_paise, ratio
from auditlens.functions.vocabulary import BEARER_BY_CLASS
from auditlens.sources.store import KEYS, Store, scoped

# --- fixed values: list labels and report volumes ---
LIST_LABELS = (
    ("LIST_I_OPTIONAL", "List I — optional (patient pays)", "PATIENT"),
    ("LIST_II_ROOM", "List II — subsumed in room (hospital absorbs)", "HOSPITAL"),
    ("LIST_III_PROCEDURE", "List III — subsumed in procedure (hospital absorbs)", "HOSPITAL"),
    ("LIST_IV_TREATMENT", "List IV — subsumed in treatment (hospital absorbs)", "HOSPITAL"),
)
ROOM_CAUSE = "Room rent cap + proportionate"
POLICY_CAUSE = "Co-pay, deductible and sub-limits"
VOLUMES = (100, 500, 1000)
# --- end of fixed values ---

RECOVERABLE = tuple(c for c, bearer in BEARER_BY_CLASS.items() if bearer == "HOSPITAL")


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _if(cond: Column, c: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")


def portfolio_summary(store: Store, tenant: str | None = None) -> DataFrame:
    """One row. `empty` is true, and the figures 0, for a portfolio without claims."""
    claims, findings, gaps = (scoped(t, tenant) for t in (store.claims, store.findings, store.doc_gaps))
    preventable = findings.agg(_if(F.col("bearer") == "HOSPITAL", "deducted_paise")).scalar()
    n_gaps = gaps.agg(F.count(F.lit(1))).scalar()
    rows = claims.agg(
        F.count(F.lit(1)).alias("claims"), F.count(F.when(F.col("ai_pipeline"), 1)).alias("ai_claims"),
        _total("gross_bill_paise").alias("gross_paise"), _total("settlement_paise").alias("settlement_paise"),
        _total("patient_liability_paise").alias("patient_paise"), _total("hospital_writeoff_paise").alias("hospital_paise"),
        _total("room_rent_deduction_paise").alias("room_rent_paise"), _total("unmapped_count").alias("unmapped_total"))
    gross = F.col("gross_paise")
    # (1 - s/g) * 100, for a negative g with both signs turned.
    sign = F.signum(gross).cast("int")
    pct = ratio((gross - F.col("settlement_paise")) * 100 * sign, F.abs(gross), 1)
    return rows.select(
        (F.col("claims") == 0).alias("empty"), "*", preventable.alias("preventable_paise"),
        F.coalesce(pct, F.lit(Decimal(0)).cast("decimal(22,1)")).alias("avg_deduction_pct"), n_gaps.alias("doc_gaps"))


def leakage_by_cause(store: Store, tenant: str | None = None) -> DataFrame:
    """(cause, amount_paise, bearer), largest first; causes without money are left out."""
    findings, claims = scoped(store.findings, tenant), scoped(store.claims, tenant)
    lists = findings.agg(*[_if(F.col("classification") == c, "deducted_paise").alias(c) for c, _, _ in LIST_LABELS])
    totals = claims.agg(_total("room_rent_deduction_paise").alias("room"), _total("patient_liability_paise").alias("patient"))
    room, patient = totals.select("room").scalar(), totals.select("patient").scalar()
    entry = lambda cause, amount, bearer: F.struct(F.lit(cause).alias("cause"), amount.alias("amount_paise"), F.lit(bearer).alias("bearer"))
    entries = [entry(label, F.col(c), bearer) for c, label, bearer in LIST_LABELS]
    entries.append(entry(ROOM_CAUSE, F.col("room"), "PATIENT"))
    entries.append(entry(POLICY_CAUSE, F.col("patient") - F.col("room") - F.col("LIST_I_OPTIONAL"), "PATIENT"))
    wide = lists.withColumns({"room": room, "patient": patient})
    return wide.select(F.inline(F.array(*entries))).where("amount_paise > 0").orderBy(F.desc("amount_paise"), "cause")


def top_leaking_items(store: Store, limit: int = 10, tenant: str | None = None) -> DataFrame:
    rows = scoped(store.findings, tenant).where((F.col("bearer") == "HOSPITAL") & (F.col("deducted_paise") > 0))
    return _per_item(rows).orderBy(F.desc("total_paise"), "item").limit(limit)


def _per_item(rows: DataFrame) -> DataFrame:
    """Per description: claims, money and the first rule.

    Two levels, so that a description on very many claims is counted claim by claim before it meets in one place.
    """
    per_claim = rows.groupBy(tx.item_key(F.col("description")).alias("item"), *KEYS).agg(
        F.sum("deducted_paise").alias("paise"),
        F.min(F.when(F.col("cited_chunk_id").isNotNull(), F.struct("claim_id", "line_no", "cited_chunk_id"))).alias("first_rule"))
    return per_claim.groupBy("item").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("paise").cast("bigint").alias("total_paise"),
        F.min("first_rule")["cited_chunk_id"].alias("cited_rule"))


def top_missing_documents(store: Store, limit: int = 10, tenant: str | None = None) -> DataFrame:
    per_claim = scoped(store.doc_gaps, tenant).select("name", "severity", *KEYS).distinct()
    return per_claim.groupBy("name", "severity").agg(F.count(F.lit(1)).alias("claims")).orderBy(F.desc("claims"), "name", "severity").limit(limit)


# --- recovery --------------------------------------------------------------------


def annual_volume(claims: Column, months: Column, given: int | None = None) -> Column:
    """Claims per year: as supplied, else the run rate of the months seen, half-even."""
    if given and given > 0:
        return F.lit(int(given)).cast("bigint")
    return div_half_even(claims * 12, F.greatest(months, F.lit(1)))


def volume_source(claims: Column, months: Column, given: int | None = None) -> Column:
    if given and given > 0:
        return F.lit("supplied by you")
    per_month = div_half_even(claims, F.greatest(months, F.lit(1)))
    return F.concat(F.lit("extrapolated from "), claims.cast("string"), F.lit(" claims over "), F.greatest(months, F.lit(1)).cast("string"),
                    F.lit(" month(s), "), per_month.cast("string"), F.lit(" a month"))


def leaking(store: Store, tenant: str | None = None) -> DataFrame:
    return scoped(store.findings, tenant).where(F.col("classification").isin(*RECOVERABLE) & (F.col("deducted_paise") > 0))


def _base(store: Store, given: int | None, tenant: str | None) -> DataFrame:
    claims = scoped(store.claims, tenant)
    months = claims.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("gross_bill_paise").alias("g"))
    return months.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("claims_audited"),
        F.greatest(F.count(F.lit(1)), F.lit(1)).cast("bigint").alias("months_observed"),
        _total("g").alias("gross_paise")).withColumn("volume", annual_volume(F.col("claims_audited"), F.col("months_observed"), given))


def recovery_items(store: Store, given: int | None = None, limit: int = 12, tenant: str | None = None) -> DataFrame:
    """Repeating charges the hospital absorbs, priced, most expensive first. Ratios are rounded once, at the end."""
    base = _base(store, given, tenant)
    n, volume = base.select("claims_audited").scalar(), base.select("volume").scalar()
    top = _per_item(leaking(store, tenant)).orderBy(F.desc("total_paise"), "item").limit(limit)
    total = F.col("total_paise")
    rows = top.withColumns({"n": n, "volume": volume})
    return rows.select(
        "item", F.col("claims").alias("claims_affected"), "total_paise", F.coalesce("cited_rule", F.lit("")).alias("cited_rule"),
        ratio(F.col("claims") * 100, F.col("n"), 1).alias("incidence_pct"),
        div_half_even(total, F.col("claims")).alias("avg_per_occurrence_paise"),
        div_half_even(total, F.col("n")).alias("leak_per_claim_paise"),
        div_half_even(total.cast("decimal(20,0)") * F.col("volume"), F.col("n")).alias("annual_recovery_paise"))


def top_three_recovery(store: Store, given: int | None = None, tenant: str | None = None) -> DataFrame:
    """One row: yearly recovery of the three most expensive items, summed exactly and rounded once."""
    base = _base(store, given, tenant)
    n, volume = base.select("claims_audited").scalar(), base.select("volume").scalar()
    top = _per_item(leaking(store, tenant)).orderBy(F.desc("total_paise"), "item").limit(3)
    total = top.agg(_total("total_paise").alias("total")).withColumns({"n": n, "volume": volume})
    safe = F.greatest(F.col("n"), F.lit(1))
    return total.select(div_half_even(F.col("total").cast("decimal(20,0)") * F.col("volume"), safe).alias("top_three_paise"))


def recovery_model(store: Store, given: int | None = None, tenant: str | None = None) -> DataFrame:
    """One row of totals; the items are in `recovery_items`."""
    total = leaking(store, tenant).agg(_total("deducted_paise")).scalar()
    rows = _base(store, given, tenant).withColumn("recoverable_paise", total)
    n, t = F.col("claims_audited"), F.col("recoverable_paise")
    safe = F.greatest(n, F.lit(1))
    sign = F.signum(F.col("gross_paise")).cast("int")
    return rows.select(
        (n == 0).alias("empty"), "claims_audited", "months_observed", "gross_paise", "recoverable_paise",
        div_half_even(t, safe).alias("leak_per_claim_paise"),
        F.coalesce(ratio(t * 100 * sign, F.abs("gross_paise"), 2), F.lit(Decimal(0)).cast("decimal(22,2)")).alias("leak_rate_pct"),
        F.col("volume").alias("annual_claim_volume"), volume_source(n, F.col("months_observed"), given).alias("volume_source"),
        div_half_even(t.cast("decimal(20,0)") * F.col("volume"), safe).alias("annual_recovery_paise"))


def assumptions(model: DataFrame) -> DataFrame:
    """(ord, assumption): what the projection rests on."""
    return model.select(F.posexplode(F.array(
        F.lit("Recoverable are item deductions the hospital bears (Lists II to IV). Room rent, co-pay, deductible and sub-limits are the patient's."),
        F.concat(F.lit("Measured over "), F.col("claims_audited").cast("string"), F.lit(" audited claim(s) in "), F.col("months_observed").cast("string"), F.lit(" month(s).")),
        F.concat(F.lit("Projected on "), F.format_number("annual_claim_volume", 0), F.lit(" claims a year: "), "volume_source", F.lit(".")),
        F.lit("The money is kept only once the charge master is corrected."))).alias("ord", "assumption"))


def preventable_by_rule(store: Store, tenant: str | None = None) -> DataFrame:
    """Per rule: money and lines the hospital bears, the largest line, rank by money."""
    rows = scoped(store.findings, tenant).where("bearer = 'HOSPITAL'")
    largest = F.max(F.struct("deducted_paise", "claim_id", "line_no"))
    return rows.groupBy(F.coalesce("cited_chunk_id", F.lit("")).alias("rule_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("deducted_paise").cast("bigint").alias("preventable_paise"),
        largest["deducted_paise"].alias("largest_paise"))


def preventable_projection(store: Store, tenant: str | None = None, volumes: tuple[int, ...] = VOLUMES) -> DataFrame:
    """Preventable money per claim at several yearly volumes, and the settlement before and after correction."""
    claims = scoped(store.claims, tenant)
    preventable = scoped(store.findings, tenant).agg(_if(F.col("bearer") == "HOSPITAL", "deducted_paise")).scalar()
    rows = claims.agg(F.count(F.lit(1)).alias("n"), _total("gross_bill_paise").alias("gross_paise"), _total("settlement_paise").alias("before_paise")).withColumn(
        "preventable_paise", preventable)
    return rows.select(
        F.explode(F.array(*[F.lit(v) for v in volumes])).alias("volume"), "gross_paise", "preventable_paise", "before_paise",
        (F.col("before_paise") + F.col("preventable_paise")).alias("after_paise"),
        F.coalesce(ratio(F.col("preventable_paise") * 100, F.col("gross_paise"), 2), F.lit(Decimal(0)).cast("decimal(22,2)")).alias("pct_of_gross"),
        "n").withColumn("projected_paise", div_half_even(F.col("preventable_paise").cast("decimal(20,0)") * F.col("volume"), F.greatest(F.col("n"), F.lit(1)))).drop("n")


# --- rule catalogue ------------------------------------------------------------------


def rules_catalog_counts(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """(list, n, verified_on): rules per list; the newest verification date of the registry on every row."""
    newest = sources.agg(F.max("verified_on")).scalar()
    return rules.groupBy(F.coalesce("list_name", F.lit("POLICY_WORDING")).alias("list")).agg(F.count(F.lit(1)).alias("n")).withColumn("verified_on", newest)


def corpus_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy(F.coalesce("list_name", "topic", F.lit("policy")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def rules_search(rules: DataFrame, text: str = "", list_name: str | None = None) -> DataFrame:
    """Rules of a list whose title, body, id or any alias contains the text, whatever the case."""
    rows = rules
    if list_name is not None:
        rows = rows.where(F.coalesce("list_name", F.lit("POLICY_WORDING")) == list_name)
    needle = text.lower()
    if not needle.strip():
        return rows
    has = lambda c: F.lower(c).contains(needle)
    return rows.where(has(F.col("title")) | has(F.col("body")) | has(F.col("chunk_id")) | F.exists("aliases", has))


def rule(rules: DataFrame, chunk_id: str) -> DataFrame:
    return rules.where(F.col("chunk_id") == chunk_id)


# --- run traces ----------------------------------------------------------------------


def trace_totals(nodes: DataFrame) -> DataFrame:
    """Per run: milliseconds and tokens."""
    return nodes.groupBy(*KEYS).agg(
        F.sum("latency_ms").alias("total_ms"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


def trace_totals_by_node(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("latency_ms").alias("total_ms"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


