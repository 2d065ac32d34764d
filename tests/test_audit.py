import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from auditlens.operators import assess, classify, waterfall
from auditlens.plans.batch import batch_totals, check_batch
from auditlens.sources import packets as pk
from auditlens.plans import audit as audit_plan
from tests.conftest import by_claim, line, packet

ROOM = line(1, "Room rent", 12000, "ROOM", quantity="3", unit_rate="4000")


def classes(run, *lines, **options):
    return {r.line_no: r for r in run(packet("C", [line(i, *l) if isinstance(l, tuple) else l for i, l in enumerate(lines, 1)]), **options)[0].findings.collect()}


def test_primary_services_stay_payable(run):
    got = classes(run, ("CAP AMOXYCILLIN 500MG", 100, "PHARMACY"), ("Shoulder blade X-ray", 100, "INVESTIGATION"), ("Soap solution enema", 100, "PHARMACY"),
                  ("Surgeon fee", 100, "PROCEDURE"))
    assert {r.classification for r in got.values()} == {"PAYABLE"} and {r.source for r in got.values()} == {"retrieval"}


def test_aliases(run):
    got = classes(run, ("Patient gown", 1), ("2 CAPS", 1), ("Capsule omeprazole", 1), ("xSTRL GLVz 7.5", 1), ("Bed pan", 1), ("MISC CHRG 4471", 1), ("A/C extra", 1),
                  ("toothbrush and tooth-brush", 1), ("capé", 1), ("gowns,", 1))
    cite = [got[i].cited_chunk_id for i in range(1, 11)]
    assert cite == ["ROM-01", "ROM-02", None, "PRO-01", "ROM-04", None, "ROM-06", "PER-05", None, "ROM-01"]
    assert got[3].classification == got[6].classification == "UNMAPPED" and got[6].severity == "BLOCKER"
    assert got[6].deducted_paise == 0 and got[6].impact_paise is None and got[1].impact_paise == 100
    assert got[1].citation == "HC/1, Part 2, items inside the room tariff" and got[1].expected.endswith("gown for the patient")


def test_anchor_join_equals_the_scan(spark, catalogue):
    """The equi-join on anchors finds exactly what testing every alias against every text finds."""
    index = [(r.alias, r.is_phrase, r.pattern) for r in classify.alias_index(catalogue[0]).collect()]
    words = ["cap", "caps", "gown", "bed pan", "uro-bag", "a/c", "gauze", "eye-sheet", "strl", "glv", "é", "tv", "file opening", "x", "-", "  "]
    texts = [f"{a}{s}{b}" for a in words for b in words for s in ("", " ", "-", "/")]
    df = spark.createDataFrame([(t.lower(),) for t in set(texts)], "text string")
    fast = {(r.text, r.alias) for r in classify.alias_matches(df, catalogue[0]).select("text", "alias").distinct().collect()}
    slow = set()
    for alias, phrase, pattern in index:
        cond = F.col("text").contains(alias) if phrase else F.col("text").rlike(pattern)
        slow |= {(r.text, alias) for r in df.where(cond).collect()}
    assert fast == slow and len(fast) > 200


def test_strategies(run, catalogue):
    assert classes(run, ("Sundry", 5), strategy="keyword")[1].classification == "PAYABLE"
    assert classes(run, ("Sundry", 5), strategy="head_only")[1].classification == "LIST_II_ROOM"
    with pytest.raises(RuntimeError):
        classes(run, ("Sundry", 5), strategy="llm")
    with pytest.raises(ValueError):
        classes(run, ("Sundry", 5), strategy="magic")


def test_failed_scorer_falls_back_with_a_note(spark, run, catalogue):
    from auditlens.operators.intake import VERDICT_SCHEMA

    def scorer(lines):
        bad = F.col("claim_id") == "BAD"
        return lines.select(
            "tenant", "claim_id", "line_no", F.when(~bad, "PAYABLE").alias("classification"), F.lit(None).cast("string").alias("cited_chunk_id"),
            F.lit("m").alias("reason"), F.lit(0.9).alias("confidence"), F.when(bad, "Timeout").alias("error"))

    assert "error string" in VERDICT_SCHEMA
    tables, _ = run(packet("BAD", [line(1, "Patient gown", 10)]), packet("GOOD", [line(1, "Patient gown", 10)]), scorer=scorer)
    got = {r.claim_id: (r.classification, r.source) for r in tables.findings.collect()}
    assert got == {"BAD": ("LIST_II_ROOM", "keyword"), "GOOD": ("PAYABLE", "llm")}
    assert by_claim(classify.scorer_errors(scorer(tables.findings)))["BAD"].error.startswith("classify: fell back")


def test_waterfall_by_hand(run):
    doc = packet("W", [line(1, "Room", 96000, "ROOM", quantity="8", unit_rate="12000"), line(2, "Surgeon", 100000, "PROCEDURE"), line(3, "Drugs", 50000, "PHARMACY"),
                       line(4, "Scan", 20000, "INVESTIGATION"), line(5, "Visit", 10000, "CONSULTATION"), line(6, "Telephone", 500), line(7, "Patient gown", 700)],
                 rate=12000, days=8, context={"discharge_date": "2026-05-12", "procedure_performed": "Left KNEE replacement"},
                 policy={"copay_percent": "10", "deductible": "1000", "procedure_sublimits": {"hip": "1", "knee": "150000", "replacement": "5"}})
    tables, _ = run(doc)
    rows = {r.profile: r for r in tables.waterfall.collect()}
    t = rows["typical"]
    assert t.room_rent_excess_taken == 4800000 and t.room_rent_proportionate_taken == 5500000
    left = 27720000 - 50000 - 70000 - 4800000 - 5500000
    assert t.procedure_sublimit_taken == left - 15000000 and t.deductible_taken == 100000 and t.copay_taken == 1490000
    assert t.settlement_paise == 13410000 and t.hospital_paise == 70000
    assert rows["conservative"].room_rent_proportionate_taken == 6500000 and rows["lenient"].room_rent_proportionate_taken == 5000000
    assert waterfall.invariant_breaks(tables.waterfall).count() == 0
    steps = [(r.step, r.inputs) for r in waterfall.deduction_rows(tables.waterfall).where("profile = 'typical'").orderBy("step_no").collect()]
    assert [s for s, _ in steps] == ["room_rent_excess", "room_rent_proportionate", "procedure_sublimit", "deductible", "copay"]
    assert steps[1][1]["heads left out"] == "IMPLANT, INVESTIGATION, PHARMACY, ROOM"


def test_room_downgrade(run):
    mixed = packet("MIXED", [line(1, "Deluxe", 40000, "ROOM", quantity="5", unit_rate="8000"), line(2, "Ward", 8000, "ROOM", quantity="2", unit_rate="4000")], rate=8000, days=5)
    total = packet("TOTAL", [line(1, "Room", 48000, "ROOM", quantity="6"), line(2, "Ward", 8000, "ROOM", quantity="2", unit_rate="4000")], rate=8000, days=6)
    repeating = packet("REPEATING", [line(1, "Room", 40000, "ROOM", quantity="3")], rate="13333.333333333333333333333333", days=3)
    within = packet("WITHIN", [ROOM])
    tables, _ = run(mixed, total, repeating, within)
    got = by_claim(waterfall.simulate_room_downgrade(tables.claims, tables.findings))
    assert {k: r.gross_paise for k, r in got.items()} == {"MIXED": 3800000, "TOTAL": 4400000, "REPEATING": 1800000}
    assert all(r.settlement_paise + r.patient_paise + r.hospital_paise == r.gross_paise for r in got.values())


def test_verdicts(run):
    clean = packet("CLEAN", [ROOM])
    unread = packet("UNREAD", [line(1, "ZZQX 4471", 90000), line(2, "Room", 10000, "ROOM", quantity="2")], rate=5000, days=2)
    busy = packet("BUSY", [ROOM, line(2, "Telephone", 500)])
    blurred = packet("BLURRED", [ROOM, line(2, "Surgeon", 50000, "PROCEDURE", extract_confidence=0.4)])
    empty = packet("EMPTY", [])
    credit = packet("CREDIT", [line(1, "Discount", -5000, "PHARMACY")])
    tables, results = run(clean, unread, busy, blurred, empty, credit)
    got = by_claim(tables.audits)
    assert {k: r.verdict for k, r in got.items()} == {
        "CLEAN": "CLEAN", "UNREAD": "CANNOT_VERIFY", "BUSY": "NEEDS_ATTENTION", "BLURRED": "CANNOT_VERIFY", "EMPTY": "CLEAN", "CREDIT": "CANNOT_VERIFY"}
    assert got["UNREAD"].coverage == Decimal("0.100") and "upper bound" in got["UNREAD"].caveat
    assert got["EMPTY"].coverage == 1 and not got["CREDIT"].verify_passed and got["CLEAN"].finding_count == 0
    totals = batch_totals(results, ["tenant"]).first()
    assert (totals.claims, totals.clean, totals.cannot_verify, totals.needs_attention) == (6, 2, 3, 1)


def test_checks(run):
    dup = [line(i, " Gauze ", 100, service_date="2026-05-05") for i in (1, 2, 3)] + [line(4, "gauze", 100)]
    docs = {
        "LOS": packet("LOS", [line(1, "Room", 20000, "ROOM")], days=5),
        "DATES": packet("DATES", [ROOM, line(2, "Drug", 70, "PHARMACY", service_date="2026-05-09"), line(3, "Drug", 30, "PHARMACY", service_date="2026-05-07")]),
        "DUP": packet("DUP", dup), "ICU": packet("ICU", [ROOM], icu=True),
        "PRE": packet("PRE", [ROOM], context={"preauth_approved_amount": "10000"}),
        "ROUND": packet("ROUND", [line(i, "Drug", 1000 * i, "PHARMACY") for i in range(1, 10)]),
        "DAY": packet("DAY", [line(1, "Room", 4000, "ROOM")], days=1, context={"discharge_date": "2026-05-04"}),
    }
    tables, _ = run(*docs.values())
    flags = {(r.claim_id, r.check_id): r.impact_paise for r in tables.flags.collect()}
    assert flags[("LOS", "CHK-LOS-ROOM")] == 800000 and flags[("DATES", "CHK-DATE-WINDOW")] == 7000
    assert flags[("DUP", "CHK-DUPLICATE-LINE")] == 20000 and flags[("PRE", "CHK-PREAUTH-VARIANCE")] == 200000
    assert flags[("ICU", "CHK-ICU-NO-CHARGE")] is None and ("ROUND", "CHK-ROUND-NUMBER") in flags
    assert [c for k, c in sorted(flags, key=str) if k == "DAY"] == ["CHK-DAYCARE-LOS", "CHK-LOS-ROOM"]
    gaps = {r.document_id for r in tables.gaps.where("claim_id = 'PRE'").collect()}
    assert gaps == {"DOC-PREAUTH-ENHANCEMENT"}


def test_findings_are_ordered(run):
    tables, _ = run(packet("O", [ROOM, line(2, "Telephone", 10), line(3, "Gauze roll", 900), line(4, "QQQ", 5)], context={"documents_attached": []}))
    merged = assess.all_findings(tables.findings, tables.gaps, tables.flags).orderBy(*assess.finding_order()).collect()
    assert [r.severity_rank for r in merged] == sorted(r.severity_rank for r in merged)
    assert merged[0].rule_id == "" and merged[1].rule_id == "DOC-CLAIM-FORM", "an unmapped line comes before the gaps"
    impacts = [r.impact_paise or 0 for r in merged if r.severity == "WARNING"]
    assert impacts == sorted(impacts, reverse=True) and impacts[0] == 90000


def test_invented_figures_are_caught(run):
    tables, _ = run(packet("V", [ROOM, line(2, "Telephone", "1234.56")]))
    texts = tables.flags.select("tenant", "claim_id", F.col("message").alias("text"))
    known = assess.known_figures(tables.facts, tables.waterfall, tables.findings, texts)
    say = lambda s: tables.claims.select("tenant", "claim_id", F.lit(s).alias("narrative"))
    bad = lambda s: [r.raw for r in assess.unsupported_figures(say(s), known).collect()]
    assert bad("Bill Rs 13,234.56, about ₹1,235, 10% of 999 and 3 days") == []
    assert bad("You lose Rs 77,777 of 13234.56") == ["77,777"]


def test_a_callers_narrative_is_verified(spark, run):
    """Its figures may come from lines, shares, the header or messages; an invented one stops the claim, and only that one."""
    docs = [packet(c, [ROOM, line(2, "Telephone", "1234.56")], rate="9000", policy={"copay_percent": "10"}) for c in "ABCDE"]
    plain, _ = run(*docs)
    told = {"A": "Room at Rs 9,000 and Rs 1,234.56 for the telephone", "B": "They lose Rs 54,321 of it", "C": None,
            "D": "about ₹1,235, " + plain.waterfall.where("claim_id = 'D' and profile = 'typical'").select(assess.rs(F.col("copay_before"))).first()[0],
            "Z": "Rs 99,999 of nobody"}
    frame = spark.createDataFrame([("t", c, s) for c, s in told.items()] + [("other", "E", "Rs 77,777")], "tenant string, claim_id string, narrative string")
    tables, results = run(*docs, narrative=frame)
    rows = by_claim(tables.audits)
    assert {c: r.verify_passed for c, r in rows.items()} == {"A": True, "B": False, "C": True, "D": True, "E": True}
    assert rows["B"].verdict == "CANNOT_VERIFY" and rows["A"].verdict == by_claim(plain.audits)["A"].verdict
    assert rows["A"].narrative == told["A"] and rows["C"].narrative == by_claim(plain.audits)["C"].narrative and results.count() == 5


def test_bad_packets_do_not_stop_the_others(run):
    good = packet("GOOD", [ROOM])
    wrong_head = packet("HEAD", [line(1, "x", 5, "MAGIC")])
    twice = packet("TWICE", [line(1, "x", 5), line(1, "y", 5)])
    undated = packet("UNDATED", [ROOM], context={"discharge_date": None})
    _, results = run(good, json.dumps(good)[:80], wrong_head, twice, undated)
    rows = results.collect()
    assert sorted(r.ok for r in rows) == [False] * 3 + [True] * 2 and by_claim(results)["TWICE"].ok
    errors = " ".join(r.error for r in rows)
    assert all(t in errors for t in ("unreadable JSON", "unknown head", "missing context.discharge_date"))


def test_a_line_number_may_come_twice(run):
    """Each line is a finding of its own; a date outside the stay puts all lines of its number under query."""
    late = {"service_date": "2026-06-01"}
    tables, results = run(packet("N", [ROOM, line(2, "Telephone", 500), line(2, "Gauze roll", 40, **late), line(3, "Stent", 7, "IMPLANT"), line(3, "Telephone", 500)]),
                          packet("P", [ROOM, line(2, "Gauze roll", 40, **late), line(3, "Telephone", 500)]))
    assert all(r.ok for r in results.collect())
    found = tables.findings.where("claim_id = 'N'").collect()
    assert sorted((r.line_no, r.description) for r in found) == [(1, "Room rent"), (2, "Gauze roll"), (2, "Telephone"), (3, "Stent"), (3, "Telephone")]
    flags = {r.claim_id: r.impact_paise for r in tables.flags.where("check_id = 'CHK-DATE-WINDOW'").collect()}
    assert flags == {"N": 54000, "P": 4000} and by_claim(tables.facts)["N"].n_outside == 1
    assert by_claim(tables.audits)["N"].gross_paise == 1304700


def test_duplicate_claims_are_refused(spark):
    packets = pk.parse_packets(spark.createDataFrame([(json.dumps(packet("A", [ROOM])),)] * 2, "json string"))
    with pytest.raises(ValueError, match="A"):
        check_batch(packets, F.lit("t"))
    with pytest.raises(ValueError, match="at most 1"):
        check_batch(packets, F.lit("t"), limit=1)


def test_packets_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(packet("A", [line(1, "x", "10.50")], policy={"procedure_sublimits": {"z": "2", "a": "1"}}), indent=2))
    (tmp_path / "b.json").write_text("{ broken")
    p = pk.read_packets(spark, str(tmp_path))
    claims = pk.packet_claims(p.where("claim_id is not null"), F.lit("t")).collect()
    assert [s.name for s in claims[0].sublimits] == ["z", "a"] and claims[0].copay_pct == 0
    row = pk.explode_lines(p.where("claim_id is not null"), F.lit("t")).first()
    assert (row.amount_paise, row.quantity, row.unit_rate_paise, row.head, row.extract_confidence) == (1050, 1, 0, "OTHER", 1.0)


def test_profiles_side_by_side(run):
    """Three profiles cost no grouping beyond that of the measures, and the attached documents are cleaned in one place of the plan."""
    tables, _ = run(packet("W1", [line(1, "Patient gown", 10), line(2, "Surgeon fee", 90000, head="PROCEDURE"),
                                   line(3, "MRI knee", 50000, head="INVESTIGATION")], rate="9000"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    folded = audit_plan.folded_profiles(tables.facts)
    assert plan(folded).count("Aggregate [") == plan(tables.facts).count("Aggregate [")
    assert plan(tables.gaps).count("regexp_replace") - plan(tables.facts).count("regexp_replace") <= 2
    row, wide = folded.first(), {r.profile: r for r in tables.waterfall.collect()}
    assert (row.low_paise, row.high_paise) == (min(r.settlement_paise for r in wide.values()), max(r.settlement_paise for r in wide.values()))
    assert row.low_paise < row.high_paise and row.balanced
    assert all(row[c] == wide["typical"][c] for c in ("settlement_paise", "patient_paise", "hospital_paise", "room_rent_paise"))


def test_texts_of_steps_that_no_one_reads_are_never_made(run):
    """F22 W11: steps are unfolded with their amounts alone; basis, inputs and formula are worked out above, if they are asked for."""
    tables, _ = run(packet("W", [line(1, "Room", 96000, "ROOM", quantity="8", unit_rate="12000"), line(2, "Surgeon", 100000, "PROCEDURE")], rate=12000, days=8))
    rows = waterfall.deduction_rows(tables.waterfall)
    plan = rows.select("step", "taken_paise", "clamped")._jdf.queryExecution().optimizedPlan().toString()
    assert "format_number" not in plan and "Room at" not in plan
    got = {(r.profile, r.step): r for r in rows.collect()}
    first = got["typical", "room_rent_excess"]
    assert first.basis == "Room at Rs 12,000.00 a day, limit Rs 6,000.00 a day, 8 days." and first.formula.startswith("min(Rs 48,000.00, Rs 196,000.00)")
    assert first.inputs["days"] == "8" and "clamped" not in first.inputs and not first.clamped


def test_findings_and_measures_can_be_kept(run):
    names = []
    tables, _ = run(packet("A", [line(1, "Telephone usage", 500)]), keep=lambda name, rows: names.append(name) or rows)
    assert names == ["findings", "facts"] and [r.n_lines for r in tables.facts.collect()] == [1]


def test_figures_in_the_row_are_those_of_the_tables(spark, run):
    """F4 V3: waterfall, flags, gaps and their texts worked out in the claim's row give the figures of the unfolded tables; so do the lines."""
    lines = [line(1, "Room", 96000, "ROOM", quantity="8", unit_rate="12000"), line(2, "Surgeon", "100000.50", "PROCEDURE"), line(3, "Telephone", "1234.50"),
             line(4, "Telephone", "1234.50"), line(5, "ZZQX", 90000), line(6, "Discount", -5000, "PHARMACY"), line(7, "Patient gown", 0)]
    policy = {"copay_percent": "10", "deductible": "1000", "procedure_sublimits": {"hip": "1", "knee": "150000"}}
    tables, _ = run(packet("A", lines, rate=12000, days=8, policy=policy, context={"procedure_performed": "knee", "preauth_approved_amount": "1000", "documents_attached": []}),
                    packet("B", [ROOM]), packet("EMPTY", []), packet("UNKNOWN", [ROOM], context={"documents_attached": [None, "DOC-FINAL-BILL"]}))
    texts = assess.message_texts(tables.gaps, tables.flags, tables.waterfall)
    unfolded = assess.known_figures(tables.facts, tables.waterfall, tables.findings, texts).values().collect()
    own = assess.known_figures(tables.facts, None, tables.findings, None).values().collect()
    assert sorted(own) == sorted(unfolded) and len(set(own)) == len(own) > 40
    assert {r.paise for r in own if r.claim_id == "A"} >= {10000050, 10000000, 123450, 123400, -500000, 0}
    assert tables.gaps.where("claim_id = 'UNKNOWN'").count() == 0, "a list with an unknown entry is not held against the claim"


def test_figures_of_lines_support_a_text_to_the_rupee(spark, run):
    """F5 V4, F7 J7: a figure may be known from a line alone; one beyond any amount is known from nowhere, and a claim without rows has none."""
    tables, _ = run(packet("A", [ROOM, line(2, "Telephone", "1234.50"), line(3, "Surgeon", "2345.50", "PROCEDURE"), line(4, "Scan", -7000, "INVESTIGATION")]))
    told = {"A": "Rs 1,234.50 or 1234, 2,345.50 or 2346, not 1235, 2345 or 7,000, nor 99999999999999999999999.99 and 999", "Z": "1,234"}
    frame = spark.createDataFrame([("t", c, s) for c, s in told.items()], "tenant string, claim_id string, narrative string")
    bad = assess.unsupported_figures(frame, assess.known_figures(tables.facts, None, tables.findings, None))
    assert sorted((r.claim_id, r.ord, r.raw) for r in bad.collect()) == [
        ("A", 4, "1235,"), ("A", 5, "2345"), ("A", 6, "7,000,"), ("A", 7, "99999999999999999999999.99"), ("Z", 0, "1,234")]
