"""Nine consistency checks, each a predicate over the measures of a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.money import rs
from auditlens.functions.rows import top_per_group
from auditlens.operators.documents import over_preauth
from auditlens.operators.facts import KEYS

# --- fixed values: check ids with severity, in registry order ---
CHECKS = (
    ("CHK-LOS-ROOM", "BLOCKER"), ("CHK-ROOM-TOTAL", "WARNING"), ("CHK-DATE-WINDOW", "WARNING"),
    ("CHK-PREAUTH-VARIANCE", "BLOCKER"), ("CHK-DUPLICATE-LINE", "WARNING"), ("CHK-ICU-NO-CHARGE", "INFO"),
    ("CHK-UNMAPPED-SHARE", "WARNING"), ("CHK-ROUND-NUMBER", "INFO"), ("CHK-DAYCARE-LOS", "INFO"),
)
ROOM_TOLERANCE_PAISE = 100
MIN_BIG_LINES = 8
# --- end of fixed values ---


def _whole(c: Column) -> Column:
    return F.round(c, 0).cast("bigint")


def conditions() -> dict[str, tuple[Column, Column, Column, str]]:
    """check id -> (fires, impact in paise or NULL, message, field)."""
    los = tx.length_of_stay(F.col("admission_date"), F.col("discharge_date"))
    days, rate = F.col("room_days"), F.col("rate_paise")
    gap = F.abs(F.col("room_billed") - rate * days)
    none = F.lit(None).cast("bigint")
    gross, n = F.col("gross_paise"), lambda c: F.col(c).cast("string")
    return {
        "CHK-LOS-ROOM": (
            days > los, _whole(rate * (days - los)),
            F.concat(F.lit("The room is billed for "), days.cast("string"), F.lit(" days, the stay has "), los.cast("string"), F.lit(".")),
            "room_stay.days"),
        "CHK-ROOM-TOTAL": (
            (F.col("room_billed") != 0) & (gap > ROOM_TOLERANCE_PAISE), _whole(gap),
            F.concat(F.lit("Room lines add up to "), rs(F.col("room_billed")), F.lit(", rate and days to "), rs(_whole(rate * days)), F.lit(".")),
            "line_items[head=ROOM].amount"),
        "CHK-DATE-WINDOW": (
            F.col("n_outside") > 0, F.col("outside_paise"),
            F.concat(n("n_outside"), F.lit(" line(s) are dated outside the stay.")), "line_items.service_date"),
        "CHK-PREAUTH-VARIANCE": (
            F.coalesce(F.col("preauth_paise") > 0, F.lit(False)) & over_preauth(), gross - F.col("preauth_paise"),
            F.concat(F.lit("The bill of "), rs(gross), F.lit(" is more than 10 % over the approved "), rs(F.col("preauth_paise")), F.lit(".")),
            "gross_bill vs context.preauth_approved_amount"),
        "CHK-DUPLICATE-LINE": (
            F.col("n_repeated") > 0, F.col("repeated_paise"),
            F.concat(n("n_repeated"), F.lit(" charge(s) appear more than once with equal amount and date.")), "line_items"),
        "CHK-ICU-NO-CHARGE": (
            F.col("is_icu") & (F.col("n_icu_named") == 0), none,
            F.lit("The stay is an ICU stay, but no line names the ICU."), "room_stay.is_icu"),
        "CHK-UNMAPPED-SHARE": (
            (gross > 0) & (F.col("unmapped_paise") * 10 > gross), F.col("unmapped_paise"),
            F.concat(rs(F.col("unmapped_paise")), F.lit(" of the bill match no catalogue entry.")), "line_items.classification"),
        "CHK-ROUND-NUMBER": (
            (F.col("n_big") >= MIN_BIG_LINES) & (F.col("n_round") * 10 > F.col("n_big") * 7), none,
            F.concat(n("n_round"), F.lit(" of "), n("n_big"), F.lit(" larger amounts are whole thousands.")), "line_items.amount"),
        "CHK-DAYCARE-LOS": (
            (los == 0) & (days > 0), none,
            F.lit("Admitted and discharged on one day, yet room charges are billed."), "context.admission_date / discharge_date"),
    }


def flag_array(facts: DataFrame) -> Column:
    """Flags of a claim as an array, most severe first, then in registry order."""
    rank = {"BLOCKER": 0, "WARNING": 1, "INFO": 2}
    found = conditions()
    ordered = sorted(enumerate(CHECKS), key=lambda c: (rank[c[1][1]], c[0]))
    return F.array_compact(F.array(*[
        F.when(found[check][0], F.struct(
            F.lit(check).alias("check_id"), F.lit(sev).alias("severity"), found[check][1].alias("impact_paise"),
            found[check][2].alias("message"), F.lit(found[check][3]).alias("field")))
        for _, (check, sev) in ordered]))


def flag_count() -> Column:
    """Number of flags of a claim, without their messages."""
    return sum((F.when(fires, 1).otherwise(0) for fires, *_ in conditions().values()), F.lit(0))


def run_checks(facts: DataFrame) -> DataFrame:
    """Long table of flags; `ord` is the position in the claim's list. One projection, no union."""
    return facts.select(*KEYS, F.posexplode(flag_array(facts)).alias("ord", "f")).select(*KEYS, "ord", "f.*")


def lines_outside_stay(lines: DataFrame, first: int = 8) -> DataFrame:
    """Per claim with a line dated outside the stay: how many, their money, and the first line numbers.

    The money is that of every line that shares a number with such a line.
    """
    numbers = lines.groupBy(*KEYS, "line_no").agg(
        F.count(F.when(F.col("outside_stay"), 1)).alias("n_out"), F.sum("amount_paise").alias("paise")).where("n_out > 0")
    totals = numbers.groupBy(*KEYS).agg(F.sum("n_out").cast("bigint").alias("n_outside"), F.sum("paise").cast("bigint").alias("outside_paise"))
    heads = top_per_group(numbers, KEYS, [F.asc("line_no")], first).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list("line_no")).alias("first_lines"))
    return totals.join(heads, KEYS)
