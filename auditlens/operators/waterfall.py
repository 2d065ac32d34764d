"""The deduction waterfall in integer paise, all claims at once.

Each step takes what it wants, but never more than the balance the step before has left. The three
insurer profiles are three rows per claim, unfolded from a constant, so nothing is joined for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.money import div_half_up, product_div_half_up, rate_per_day, rs
from auditlens.functions.vocabulary import HEADS
from auditlens.operators.facts import KEYS, with_facts

# --- fixed values: insurer profiles and step names ---
PROFILES = {
    "conservative": ("PHARMACY", "IMPLANT"),
    "typical": ("PHARMACY", "IMPLANT", "INVESTIGATION"),
    "lenient": ("PHARMACY", "IMPLANT", "INVESTIGATION", "CONSULTATION"),
}
STEPS = (
    "room_rent_excess", "room_rent_proportionate", "procedure_sublimit",
    "deductible", "copay", "sum_insured_cap",
)
# --- end of fixed values ---

def _zero() -> Column:
    return F.lit(0).cast("bigint")


def per_profile(claims: DataFrame, profiles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    table = F.array(*[
        F.struct(F.lit(name).alias("profile"), F.array(*[F.lit(h) for h in heads]).alias("excluded_heads"))
        for name, heads in (profiles or PROFILES).items()])
    return claims.select("*", F.inline(table))


def room_cap(df: DataFrame) -> Column:
    return F.when(F.col("is_icu"), F.col("icu_cap_paise")).otherwise(F.col("room_cap_paise"))


def waterfall(facts: DataFrame, profiles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """claim x profile: every `<step>_wanted`, `<step>_taken`, and the three shares of the bill."""
    return with_steps(per_profile(with_shared(facts), profiles), lambda head: F.array_contains("excluded_heads", head)).drop(*SHARED)


SHARED = ("whole_rate", "named_limits", "excess_wanted")
STEP_INPUTS = (
    *SHARED, "cap_paise", "over_cap", "item_total", "balance_0", "gross_paise", "patient_items", "hospital_items", "rate_paise",
    "deductible_paise", "copay_pct", "balance_paise", *[f"payable_{h.lower()}" for h in HEADS if h != "ROOM"])


def with_shared(facts: DataFrame) -> DataFrame:
    """What the steps need and no profile changes, worked out once per claim; the columns of `SHARED` are for `with_steps` alone."""
    cap, rate, whole = room_cap(facts), F.col("rate_paise"), F.col("whole_rate")
    name = F.lower(F.coalesce("procedure", F.lit("")))
    limits = F.filter("sublimits", lambda s: F.contains(name, F.lower(s["name"])))
    df = facts.withColumns({
        "cap_paise": cap, "over_cap": F.coalesce((cap > 0) & (rate > cap), F.lit(False)),
        "item_total": F.col("patient_items") + F.col("hospital_items"),
        "balance_0": F.col("gross_paise") - F.col("patient_items") - F.col("hospital_items"),
        "whole_rate": F.when(rate.cast("bigint") == rate, rate.cast("bigint")),
        "named_limits": F.when(F.size("sublimits") > 0, limits),
    })
    # A rate in whole paise needs no decimals.
    excess_days = F.when(whole.isNotNull() & (whole <= 10**12) & (F.col("room_days") <= 10**6), (whole - F.col("cap_paise")) * F.col("room_days")).otherwise(
        F.round((rate - F.col("cap_paise").cast("decimal(24,6)")) * F.col("room_days"), 0).cast("bigint"))
    return df.withColumn("excess_wanted", F.when(F.col("over_cap"), F.least(excess_days, F.col("payable_room"))))


def with_steps(df: DataFrame, excluded: Callable[[str], Column]) -> DataFrame:
    """The columns of `waterfall`, from those of `with_shared`, under the profile that leaves out the heads for which `excluded` holds."""
    rate, whole_rate = F.col("rate_paise"), F.col("whole_rate")
    associated = sum(
        (F.when(excluded(h), _zero()).otherwise(F.col(f"payable_{h.lower()}"))
         for h in HEADS if h != "ROOM"), _zero())
    df = df.withColumn("associated_paise", associated)
    # Rates carry six decimals of a paisa; scaled up, the proportion is one exact integer division. A rate in
    # whole paise needs no scaling.
    scaled = lambda c: (c.cast("decimal(24,6)") * F.lit(1_000_000)).cast("decimal(30,0)")
    base = F.greatest(F.col("associated_paise"), _zero())
    share = F.when(
        whole_rate.isNotNull(), product_div_half_up(base, whole_rate - F.col("cap_paise"), whole_rate, 40_000_000_000, 100_000_000),
    ).otherwise(div_half_up(base.cast("decimal(20,0)") * scaled(rate - F.col("cap_paise").cast("decimal(24,6)")), scaled(rate)))
    balance = F.col("balance")
    first_limit = F.try_element_at(F.filter("named_limits", lambda s: balance > s["limit_paise"]), F.lit(1))
    wants = {
        "room_rent_excess": F.col("excess_wanted"),
        "room_rent_proportionate": F.when(F.col("over_cap"), share),
        "procedure_sublimit": balance - F.col("sublimit")["limit_paise"],
        "deductible": F.col("deductible_paise"),
        "copay": F.when((F.col("copay_pct") > 0) & (balance > 0),
                        product_div_half_up(balance, (F.col("copay_pct") * 100).cast("bigint"), F.lit(10_000), 40_000_000_000_000, 100_000)),
        "sum_insured_cap": F.when(balance > F.col("balance_paise"), balance - F.col("balance_paise")),
    }
    df = df.withColumn("balance", F.col("balance_0"))
    for step, want in wants.items():
        if step == "procedure_sublimit":
            df = df.withColumn("sublimit", first_limit)
        df = df.withColumn(f"{step}_before", balance)
        df = df.withColumn(f"{step}_wanted", F.greatest(F.coalesce(want, _zero()), _zero()).cast("bigint"))
        df = df.withColumn(f"{step}_taken", F.greatest(F.least(F.col(f"{step}_wanted"), balance), _zero()))
        df = df.withColumn("balance", balance - F.col(f"{step}_taken"))
    policy = sum((F.col(f"{s}_taken") for s in STEPS), _zero())
    return df.withColumns({
        "policy_total": policy,
        "settlement_paise": balance,
        "patient_paise": F.col("patient_items") + policy,
        "hospital_paise": F.col("hospital_items"),
        "room_rent_paise": F.col("room_rent_excess_taken") + F.col("room_rent_proportionate_taken"),
    }).drop("balance")


def step_basis(profile: Column) -> dict[str, Column]:
    """step -> what it rests on, in words; for a row of `with_steps` under `profile`."""
    cap, rate, limit = F.col("cap_paise"), F.col("rate_paise").cast("bigint"), F.col("sublimit")
    return {
        "room_rent_excess": F.concat(
            F.lit("Room at "), rs(rate), F.lit(" a day, limit "), rs(cap), F.lit(" a day, "), F.col("room_days").cast("string"), F.lit(" days.")),
        "room_rent_proportionate": F.concat(
            F.lit("Associated charges of "), rs(F.col("associated_paise")), F.lit(" cut by 1 - "), rs(cap), F.lit(" / "), rs(rate),
            F.lit(" under profile "), profile, F.lit(".")),
        "procedure_sublimit": F.concat(F.lit("Sub-limit for "), limit["name"], F.lit(": "), rs(limit["limit_paise"]), F.lit(".")),
        "deductible": F.concat(F.lit("Deductible of "), rs(F.col("deductible_paise")), F.lit(".")),
        "copay": F.concat(F.lit("Co-pay of "), F.col("copay_pct").cast("string"), F.lit("% on "), rs(F.col("copay_before")), F.lit(".")),
        "sum_insured_cap": F.concat(F.lit("Sum insured left: "), rs(F.col("balance_paise")), F.lit(".")),
    }


def deduction_rows(wf: DataFrame) -> DataFrame:
    """One row per step that took money, with its inputs, formula and a note when it was clamped."""
    cap, rate = F.col("cap_paise"), F.col("rate_paise").cast("bigint")
    excluded = F.array_join(F.array_sort(F.concat(F.col("excluded_heads"), F.array(F.lit("ROOM")))), ", ")

    def m(*pairs: Column | str) -> Column:
        return F.create_map(*[F.lit(p) if isinstance(p, str) else p for p in pairs])

    given = {
        "room_rent_excess": m("rate per day", rs(rate), "limit per day", rs(cap), "days", F.col("room_days").cast("string"),
                              "room charges on the claim", rs(F.col("payable_room"))),
        "room_rent_proportionate": m("associated charges", rs(F.col("associated_paise")), "heads left out", excluded),
        "procedure_sublimit": m("procedure", F.coalesce("procedure", F.lit("")), "sub-limit", rs(F.col("sublimit")["limit_paise"])),
        "deductible": m("deductible", rs(F.col("deductible_paise"))),
        "copay": m("rate", F.concat(F.col("copay_pct").cast("string"), F.lit("%")), "admissible", rs(F.col("copay_before"))),
        "sum_insured_cap": m("sum insured left", rs(F.col("balance_paise")), "claim at this step", rs(F.col("sum_insured_cap_before"))),
    }
    # Unfolded first, with the amounts alone: texts are made for the steps that took money, and those no one reads are never made.
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(step).alias("step"), F.col(f"{step}_taken").alias("taken_paise"),
                     F.col(f"{step}_wanted").alias("wanted_paise"), F.col(f"{step}_before").alias("_before")) for i, step in enumerate(STEPS, 1)]
    unfolded = wf.select("*", F.inline(F.filter(F.array(*rows), lambda r: r["taken_paise"] > 0)))
    taken, wanted, before = F.col("taken_paise"), F.col("wanted_paise"), F.col("_before")

    def by_step(texts: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(F.col("step") == step, texts[step]) for step in STEPS])

    note = F.when(taken != wanted, m("clamped", F.concat(F.lit("computed "), rs(wanted), F.lit(", left "), rs(before))))
    formula = F.concat(F.lit("min("), rs(wanted), F.lit(", "), rs(before), F.lit(") = "), rs(taken))
    named = unfolded.withColumn("inputs", by_step(given))
    return named.select(
        *KEYS, "profile", "step_no", "step", by_step(step_basis(F.col("profile"))).alias("basis"), "taken_paise", "wanted_paise", (taken != wanted).alias("clamped"),
        F.coalesce(F.map_concat("inputs", note), "inputs").alias("inputs"), formula.alias("formula"))


def invariant_breaks(wf: DataFrame) -> DataFrame:
    """Rows (tenant, claim_id, profile) where the three shares do not add up to the bill. Always empty."""
    broken = F.col("settlement_paise") + F.col("patient_paise") + F.col("hospital_paise") != F.col("gross_paise")
    return wf.groupBy(*KEYS, "profile").agg(F.bool_or(broken).alias("broken")).where("broken")


def settlement_range(wf: DataFrame) -> DataFrame:
    typical = F.when(F.col("profile") == "typical", F.col("settlement_paise"))
    return wf.groupBy(*KEYS).agg(
        F.min("settlement_paise").alias("low_paise"), F.max("settlement_paise").alias("high_paise"), F.max(typical).alias("typical_paise"))


def downgrade_lines(claims: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims over their room limit and their lines, as if the room had cost exactly the limit.

    Only room lines billed at the rate of the stay change; a ward row at another rate keeps its amount.
    """
    cap, rate = room_cap(claims), F.col("rate_paise")
    over = claims.where(F.coalesce((cap != 0) & (rate > cap), F.lit(False)))
    terms = over.select(*KEYS, rate.alias("_rate"), cap.cast("decimal(24,6)").alias("_cap"))
    amount, qty = F.col("amount_paise"), F.col("quantity")
    own_rate = rate_per_day(F.col("unit_rate_paise"), qty, amount)
    cheaper = F.round(amount - (F.col("_rate") - F.col("_cap")) * qty, 0).cast("bigint")
    stay_row = (F.col("head") == "ROOM") & (own_rate == F.col("_rate"))
    moved = (
        findings.join(terms, KEYS)
        .withColumn("amount_paise", F.when(stay_row, cheaper).otherwise(amount))
        .withColumn("unit_rate_paise", F.when(stay_row, F.col("_cap").cast("bigint")).otherwise(F.col("unit_rate_paise")))
        .drop("_rate", "_cap")
    )
    return over.withColumn("rate_paise", room_cap(over).cast("decimal(24,6)")), moved


def simulate_room_downgrade(claims: DataFrame, findings: DataFrame, profile: str = "typical") -> DataFrame:
    """Waterfall of the cheaper room next to the real one. Claims within their limit are absent."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    one = {profile: PROFILES[profile]}
    claims2, findings2 = downgrade_lines(claims, findings)
    before = waterfall(with_facts(claims, findings), one).select(*KEYS, F.col("settlement_paise").alias("before_paise"))
    after = waterfall(with_facts(claims2, findings2), one)
    return after.join(before, KEYS).select(
        *KEYS, "profile", "gross_paise", "settlement_paise", "patient_paise", "hospital_paise", "before_paise",
        (F.col("settlement_paise") - F.col("before_paise")).alias("gain_paise"))
