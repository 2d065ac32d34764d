"""Cases for the store, its readers, portfolio, recovery, ledger and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.functions import vocabulary as voc
from auditlens.functions.rows import sized
from auditlens.operators import anchors, assess, ledger, portfolio, retention
from auditlens.plans import adhoc
from auditlens.session import shared_dir
from auditlens.sources import store as st
from suite import base as b
from suite.base import CTES, case

K = ["tenant", "claim_id"]

CTES["s_claims"] = """
SELECT tenant, claim_id, CAST(discharge_date + 1 AS TIMESTAMP) AS audited_at, month, diagnosis, procedure, gross_paise AS gross_bill_paise, settlement_paise,
 patient_paise AS patient_liability_paise, hospital_paise AS hospital_writeoff_paise, room_rent_paise AS room_rent_deduction_paise, unmapped_count, doc_gap_count FROM audits"""
CTES["s_findings"] = "SELECT tenant, claim_id, line_no, description, head, classification, bearer, amount_paise, deducted_paise, cited_chunk_id FROM findings"
CTES["s_gaps"] = "SELECT tenant, claim_id, document_id, name, severity FROM gaps"

_S = ["tenant", "claim_id", "month", "diagnosis", "procedure", "gross_bill_paise", "settlement_paise", "patient_liability_paise", "hospital_writeoff_paise",
      "room_rent_deduction_paise", "unmapped_count", "doc_gap_count"]


@case("SNK1", """SELECT tenant, claim_id, line_no, amount_paise, description FROM s_findings WHERE CAST(substr(claim_id, 5) AS BIGINT) % 3 <> 0
 UNION ALL SELECT tenant, claim_id, line_no, amount_paise + 1, 'again: ' || description FROM s_findings WHERE CAST(substr(claim_id, 5) AS BIGINT) % 3 = 0 AND amount_paise >= 0""")
def snk1(x):
    third = F.substring("claim_id", 5, 20).cast("bigint") % 3 == 0
    old = x.store.findings.select(*K, "line_no", "amount_paise", "description")
    again = old.where(third)
    new = again.where("amount_paise >= 0").select(*K, "line_no", F.col("amount_paise") + 1, F.concat(F.lit("again: "), "description"))
    return st.upsert_rows(old, new.toDF(*old.columns), again)


@case("SNK1F", """SELECT c.tenant, c.claim_id, CASE WHEN third THEN '1999-01' ELSE month END AS month, COALESCE(n_findings, 0) AS n_findings, CASE WHEN third THEN 0 ELSE COALESCE(n_gaps, 0) END AS n_gaps
 FROM (SELECT *, CAST(substr(claim_id, 5) AS BIGINT) % 3 = 0 AS third FROM s_claims) c
 LEFT JOIN (SELECT tenant, claim_id, count(*) FILTER (amount_paise >= 0 OR CAST(substr(claim_id, 5) AS BIGINT) % 3 <> 0) AS n_findings FROM s_findings GROUP BY ALL) f ON f.tenant = c.tenant AND f.claim_id = c.claim_id
 LEFT JOIN (SELECT tenant, claim_id, count(*) AS n_gaps FROM s_gaps GROUP BY ALL) g ON g.tenant = c.tenant AND g.claim_id = c.claim_id
 ANTI JOIN erasures r ON r.tenant = c.tenant AND r.claim_id = c.claim_id""")
def snk1f(x):
    """Saved, a third saved again for another month and without gaps, a fifth erased: what the files then hold."""
    path = f"{shared_dir(x.spark)}/store-{x.spark.sparkContext.applicationId}-{id(x)}-{b.next_number()}"
    third = F.substring("claim_id", 5, 20).cast("bigint") % 3 == 0
    audit = x.kept_audit("line_no")
    st.save_store(path, st.store_rows(audit))
    x.release(audit)
    kept = st.read_store(x.spark, path)
    st.save_store(path, st.Store(kept.claims.where(third).withColumn("month", F.lit("1999-01")), kept.findings.where(third & (F.col("amount_paise") >= 0)), kept.doc_gaps.limit(0)))
    requests = x.claims.where(F.substring("claim_id", 5, 20).cast("bigint") % 5 == 0).select(*K)
    retention.erase_from_store(x.spark, path, requests, F.lit("2026-01-01T00:00:00+00:00"), "e1", f"{path}-ledger")
    now = st.read_store(x.spark, path)
    count = lambda df, name: df.groupBy(*K).agg(F.count(F.lit(1)).alias(name))
    zero = F.lit(0).cast("bigint")
    return (now.claims.select(*K, "month").join(count(now.findings, "n_findings"), K, "left").join(count(now.doc_gaps, "n_gaps"), K, "left")
            .withColumns({c: F.coalesce(c, zero) for c in ("n_findings", "n_gaps")}))


@case("SNK2", f"SELECT {', '.join(_S)}, CAST(audited_at AS VARCHAR) AS audited_at FROM s_claims")
def snk2(x):
    return x.store.claims.select(*_S, F.col("audited_at").cast("string").alias("audited_at"))


@case("SNK3", """SELECT tenant, claim_id, CAST(gross_bill_paise // 100 AS BIGINT) AS gross_bill, CAST(settlement_paise // 100 AS BIGINT) AS settlement, gross_bill_paise FROM (
 SELECT tenant, claim_id, gross_bill_paise, settlement_paise FROM s_claims WHERE gross_bill_paise >= 0 AND settlement_paise >= 0)
 UNION ALL SELECT tenant, claim_id, CAST(trunc(gross_bill_paise / 100) AS BIGINT), CAST(trunc(settlement_paise / 100) AS BIGINT), gross_bill_paise FROM s_claims WHERE NOT (gross_bill_paise >= 0 AND settlement_paise >= 0)""")
def snk3(x):
    return st.rupee_view(x.store.claims).select(*K, "gross_bill", "settlement", "gross_bill_paise")


@case("SNK4", f"SELECT tenant, claim_id, line_no, {b.decimal_text('amount_paise', 2)} AS amount, {b.decimal_text('deducted_paise', 2)} AS deducted FROM s_findings")
def snk4(x):
    return st.exact_money(x.store.findings).select(*K, "line_no", F.col("amount").cast("string").alias("amount"), F.col("deducted").cast("string").alias("deducted"))


@case("SNK5", "SELECT tenant, count(*) AS n, CAST(sum(gross_bill_paise) AS BIGINT) AS paise FROM s_claims WHERE tenant = 'T1' GROUP BY tenant")
def snk5(x):
    own = x.spark.newSession()
    st.register_views(own, x.store, "T1")
    return own.sql("SELECT tenant, count(*) AS n, sum(gross_bill_paise) AS paise FROM v_claims GROUP BY tenant")


@case("SNK7", "SELECT tenant, claim_id, line_no FROM s_findings WHERE CAST(substr(claim_id, 5) AS BIGINT) % 7 = 0")
def snk7(x):
    kept = x.store.claims.where(F.substring("claim_id", 5, 20).cast("bigint") % 7 != 0)
    return st.orphans(x.store.findings, kept).select(*K, "line_no")


# --- readers -----------------------------------------------------------------------

_PAGE = "SELECT tenant, claim_id, month, CAST(audited_at AS VARCHAR) AS audited_at, {money} AS gross_bill FROM s_claims WHERE {where} ORDER BY s_claims.audited_at DESC, claim_id, tenant LIMIT 50 OFFSET 25"


@case("FL1", _PAGE.format(money=b.decimal_text("gross_bill_paise", 2), where="tenant = 'T2' AND (claim_id ILIKE '%urgent%' OR diagnosis ILIKE '%urgent%')"))
def fl1(x):
    page, _ = st.list_claims(x.store.claims, query=" urgent ", limit=50, offset=25, tenant="T2")
    return page.select(*K, "month", F.col("audited_at").cast("string").alias("audited_at"), F.col("gross_bill").cast("string").alias("gross_bill"))


@case("FL2", f"SELECT line_no, description, head, classification, bearer, {b.decimal_text('amount_paise', 2)} AS amount, cited_chunk_id FROM s_findings WHERE claim_id = 'CLM-33'")
def fl2(x):
    return st.claim_findings(x.store.findings, "CLM-33").select("line_no", "description", "head", "classification", "bearer", F.col("amount").cast("string").alias("amount"), "cited_chunk_id")


@case("FL3", "SELECT tenant, claim_id, document_id, name, severity FROM s_gaps WHERE claim_id = 'CLM-33'")
def fl3(x):
    return st.claim_gaps(x.store.doc_gaps, "CLM-33")


@case("FL4", """SELECT c.tenant, c.claim_id, c.gross_bill_paise, (SELECT string_agg(line_no || ':' || classification, ',' ORDER BY line_no) FROM s_findings f WHERE f.claim_id = 'CLM-33') AS findings,
 (SELECT string_agg(document_id, ',' ORDER BY document_id) FROM s_gaps g WHERE g.claim_id = 'CLM-33') AS gaps FROM s_claims c WHERE claim_id = 'CLM-33'""")
def fl4(x):
    joined = lambda arr, fn: F.array_join(F.transform(arr, fn), ",")
    return st.get_claim(x.store, "CLM-33").select(
        *K, "gross_bill_paise", joined("findings", lambda f: F.concat(f["line_no"].cast("string"), F.lit(":"), f["classification"])).alias("findings"),
        joined("document_gaps", lambda g: g["document_id"]).alias("gaps"))


@case("FL5", "SELECT DISTINCT month FROM s_claims WHERE tenant = 'T3'")
def fl5(x):
    return st.months(x.store.claims, "T3")


@case("FL9", "SELECT tenant, claim_id, line_no FROM lines WHERE extract_confidence < 0.7")
def fl9(x):
    return assess.low_confidence_lines(x.lines).select(*K, "line_no")


@case("FL10", "SELECT 'deducted' AS kind, tenant, claim_id, line_no FROM findings WHERE deducted_paise > 0 UNION ALL SELECT 'unmapped', tenant, claim_id, line_no FROM findings WHERE classification = 'UNMAPPED'")
def fl10(x):
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), *K, "line_no")
    f = x.audit.findings
    return pick(assess.deducted_items(f), "deducted").unionByName(pick(assess.unmapped_items(f), "unmapped"))


# --- portfolio -----------------------------------------------------------------------

_SUM = lambda c: f"CAST(COALESCE(sum({c}), 0) AS BIGINT)"


@case("P1", f"""SELECT n = 0 AS empty, n AS claims, 0 AS ai_claims, gross_paise, settlement_paise, patient_paise, hospital_paise, room_rent_paise, unmapped_total,
 (SELECT {_SUM('deducted_paise')} FROM s_findings WHERE bearer = 'HOSPITAL') AS preventable_paise, {b.decimal_text(b.half_even('(gross_paise - settlement_paise) * 1000', 'gross_paise'), 1)} AS avg_deduction_pct,
 (SELECT count(*) FROM s_gaps) AS doc_gaps FROM (SELECT count(*) AS n, {_SUM('gross_bill_paise')} AS gross_paise, {_SUM('settlement_paise')} AS settlement_paise,
 {_SUM('patient_liability_paise')} AS patient_paise, {_SUM('hospital_writeoff_paise')} AS hospital_paise, {_SUM('room_rent_deduction_paise')} AS room_rent_paise,
 {_SUM('unmapped_count')} AS unmapped_total FROM s_claims)""")
def p1(x):
    out = portfolio.portfolio_summary(x.store)
    return out.withColumn("avg_deduction_pct", F.col("avg_deduction_pct").cast("string"))


@case("P2", f"""SELECT * FROM (SELECT CASE classification WHEN 'LIST_I_OPTIONAL' THEN 'List I — optional (patient pays)' WHEN 'LIST_II_ROOM' THEN 'List II — subsumed in room (hospital absorbs)'
 WHEN 'LIST_III_PROCEDURE' THEN 'List III — subsumed in procedure (hospital absorbs)' ELSE 'List IV — subsumed in treatment (hospital absorbs)' END AS cause, {_SUM('deducted_paise')} AS amount_paise,
 CASE WHEN classification = 'LIST_I_OPTIONAL' THEN 'PATIENT' ELSE 'HOSPITAL' END AS bearer FROM s_findings WHERE classification LIKE 'LIST_%' GROUP BY classification
 UNION ALL SELECT 'Room rent cap + proportionate', {_SUM('room_rent_deduction_paise')}, 'PATIENT' FROM s_claims
 UNION ALL SELECT 'Co-pay, deductible and sub-limits', {_SUM('patient_liability_paise')} - {_SUM('room_rent_deduction_paise')} - (SELECT {_SUM('deducted_paise')} FROM s_findings WHERE classification = 'LIST_I_OPTIONAL'), 'PATIENT' FROM s_claims)
 WHERE amount_paise > 0""")
def p2(x):
    return portfolio.leakage_by_cause(x.store)


CTES["leak_items"] = f"""
SELECT lower(trim(description)) AS item, count(DISTINCT tenant || '/' || claim_id) AS claims, {_SUM('deducted_paise')} AS total_paise,
 arg_min(cited_chunk_id, claim_id || '#' || lpad(CAST(line_no AS VARCHAR), 20, '0')) FILTER (cited_chunk_id IS NOT NULL) AS cited_rule FROM s_findings
WHERE classification IN ('LIST_II_ROOM', 'LIST_III_PROCEDURE', 'LIST_IV_TREATMENT') AND deducted_paise > 0 GROUP BY 1"""


@case("P3", f"""SELECT lower(trim(description)) AS item, count(DISTINCT tenant || '/' || claim_id) AS claims, {_SUM('deducted_paise')} AS total_paise FROM s_findings
 WHERE bearer = 'HOSPITAL' AND deducted_paise > 0 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""")
def p3(x):
    return portfolio.top_leaking_items(x.store).select("item", "claims", "total_paise")


@case("P4", "SELECT name, severity, count(DISTINCT tenant || '/' || claim_id) AS claims FROM s_gaps GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 10")
def p4(x):
    return portfolio.top_missing_documents(x.store)


CTES["rec_base"] = f"""
SELECT *, {b.half_even('n * 12', 'months')} AS volume FROM (SELECT count(*) AS n, greatest(count(DISTINCT month), 1) AS months, {_SUM('gross_bill_paise')} AS gross_paise,
 (SELECT {_SUM('total_paise')} FROM leak_items) AS total FROM s_claims)"""


@case("P5", f"""SELECT n = 0 AS empty, n AS claims_audited, months AS months_observed, gross_paise, total AS recoverable_paise, CAST({b.half_even('total', 'n')} AS BIGINT) AS leak_per_claim_paise,
 {b.decimal_text(b.half_even('total::HUGEINT * 10000', 'gross_paise'), 2)} AS leak_rate_pct, CAST(volume AS BIGINT) AS annual_claim_volume,
 CAST({b.half_even('total::HUGEINT * volume', 'n')} AS BIGINT) AS annual_recovery_paise FROM rec_base""")
def p5(x):
    out = portfolio.recovery_model(x.store)
    return out.drop("volume_source").withColumn("leak_rate_pct", F.col("leak_rate_pct").cast("string"))


@case("P6", f"SELECT tenant, n, months, CAST({b.half_even('n * 12', 'months')} AS BIGINT) AS volume FROM (SELECT tenant, count(*) AS n, count(DISTINCT month) AS months FROM s_claims GROUP BY tenant)")
def p6(x):
    sums = x.store.claims.groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("month").alias("months"))
    return sums.withColumn("volume", portfolio.annual_volume(F.col("n"), F.col("months")))


@case("P7", f"""SELECT item, claims AS claims_affected, total_paise, COALESCE(cited_rule, '') AS cited_rule, {b.decimal_text(b.half_even('claims * 1000', 'n'), 1)} AS incidence_pct,
 CAST({b.half_even('total_paise', 'claims')} AS BIGINT) AS avg_per_occurrence_paise, CAST({b.half_even('total_paise', 'n')} AS BIGINT) AS leak_per_claim_paise,
 CAST({b.half_even('total_paise::HUGEINT * volume', 'n')} AS BIGINT) AS annual_recovery_paise FROM leak_items, rec_base ORDER BY total_paise DESC, item LIMIT 12""")
def p7(x):
    return portfolio.recovery_items(x.store).withColumn("incidence_pct", F.col("incidence_pct").cast("string"))


@case("P8", f"""SELECT CAST({b.half_even('t::HUGEINT * volume', 'n')} AS BIGINT) AS top_three_paise FROM rec_base,
 (SELECT sum(total_paise) AS t FROM (SELECT total_paise FROM leak_items ORDER BY total_paise DESC, item LIMIT 3))""")
def p8(x):
    return portfolio.top_three_recovery(x.store)


CTES["by_rule"] = f"""SELECT COALESCE(cited_chunk_id, '') AS rule_id, count(*) AS n_lines, {_SUM('deducted_paise')} AS preventable_paise, max(deducted_paise) AS largest_paise
 FROM s_findings WHERE bearer = 'HOSPITAL' GROUP BY 1"""


@case("P12", f"""SELECT 'rule ' || rule_id AS part, n_lines AS n, preventable_paise AS paise, largest_paise AS extra FROM by_rule
 UNION ALL SELECT 'volume ' || v, v, CAST({b.half_even('p::HUGEINT * v', 'n')} AS BIGINT), s + p FROM (VALUES (100), (500), (1000)) AS t(v),
 (SELECT count(*) AS n, {_SUM('settlement_paise')} AS s, (SELECT {_SUM('preventable_paise')} FROM by_rule) AS p FROM s_claims)""")
def p12(x):
    by_rule = portfolio.preventable_by_rule(x.store).select(
        F.concat(F.lit("rule "), "rule_id").alias("part"), F.col("n_lines").alias("n"), F.col("preventable_paise").alias("paise"), F.col("largest_paise").alias("extra"))
    proj = portfolio.preventable_projection(x.store).select(
        F.concat(F.lit("volume "), F.col("volume").cast("string")).alias("part"), F.col("volume").cast("bigint").alias("n"),
        F.col("projected_paise").alias("paise"), F.col("after_paise").alias("extra"))
    return by_rule.unionByName(proj)


@case("ADH1", """SELECT month, count(*) AS n, CAST(sum(gross_bill_paise) AS BIGINT) AS paise FROM s_claims WHERE tenant = 'T1' GROUP BY month""")
def adh1(x):
    sql = "WITH monthly AS (SELECT month, count(*) AS n, sum(gross_bill_paise) AS paise FROM v_claims WHERE month <> 'drop' GROUP BY month) SELECT * FROM monthly -- all of it"
    return adhoc.guarded_sql(x.spark, x.store, sql, "T1")


@case("ADH2", "SELECT head, count(*) AS n, CAST(sum(deducted_paise) AS BIGINT) AS paise FROM s_findings WHERE tenant = 'T2' GROUP BY head")
def adh2(x):
    df = adhoc.guarded_sql(x.spark, x.store, "SELECT head, count(*) AS n, sum(deducted_paise) AS paise FROM v_findings GROUP BY head", "T2")
    return x.spark.createDataFrame(adhoc.bounded_run(df, timeout_s=600.0), df.schema)


# --- ledger ------------------------------------------------------------------------

_LED = ["tenant", "claim_id", "verdict", "strategy", "gross_paise", "settlement_paise", "patient_paise", "hospital_paise", "finding_counts", "verify_passed"]


def small_digest(x) -> DataFrame:
    return ledger.packet_digest(x.claims.select(*K, "claim_type"), x.lines.select(*K, "line_no", "amount_paise"))


def ledger_rows(x) -> DataFrame:
    stamp = F.concat(F.col("discharge_date").cast("string"), F.lit("T00:00:00+00:00"))
    return ledger.ledger_rows(x.kept_audit().audits.withColumn("corpus_version", F.lit("v1")), small_digest(x), stamp, key_id="k1")


_LANES = ", ".join(f"sum(CAST('0x' || substr(h, {i * 15 + 1}, 15) AS BIGINT)) AS s{i}" for i in range(4))
CTES["digests"] = f"""SELECT c.tenant, c.claim_id, sha256('{{"claim_id":"' || c.claim_id || '","claim_type":"' || claim_type || '","tenant":"' || c.tenant || '"}}'
 || '#' || concat_ws('|', COALESCE(n, 0), COALESCE(s0, 0), COALESCE(s1, 0), COALESCE(s2, 0), COALESCE(s3, 0))) AS packet_digest
 FROM claims0 c LEFT JOIN (SELECT tenant, claim_id, count(*) AS n, {_LANES} FROM (SELECT tenant, claim_id, sha256(amount_paise || '|' || line_no) AS h FROM lines)
 GROUP BY tenant, claim_id) l ON l.tenant = c.tenant AND l.claim_id = c.claim_id"""
CTES["ledger_rows"] = """
SELECT a.discharge_date || 'T00:00:00+00:00' AS recorded_at, a.tenant, 'k1' AS key_id, a.claim_id, d.packet_digest, 'v1' AS corpus_version, 'deterministic' AS strategy, a.verdict,
 gross_paise, settlement_paise, patient_paise, hospital_paise, finding_counts, CAST(verify_passed AS INTEGER) AS verify_passed
FROM audits a JOIN digests d ON d.tenant = a.tenant AND d.claim_id = a.claim_id JOIN counts_json j ON j.tenant = a.tenant AND j.claim_id = a.claim_id"""
CTES["stems"] = """
SELECT *, concat_ws('|', recorded_at, tenant, key_id, claim_id, packet_digest, corpus_version, strategy, verdict, gross_paise, settlement_paise, patient_paise, hospital_paise,
 finding_counts, verify_passed) AS stem FROM ledger_rows"""
CTES["placed"] = """
SELECT *, row_number() OVER (PARTITION BY chain ORDER BY recorded_at, claim_id) AS seq FROM (
 SELECT s.*, s.tenant || '/b1/' || CAST('0x' || left(sha256(stem), 12) AS BIGINT) % CAST(ceil(n / 256) AS BIGINT) AS chain
 FROM stems s JOIN (SELECT tenant, count(*) AS n FROM stems GROUP BY tenant) t ON t.tenant = s.tenant)"""
CTES["chained"] = """
SELECT chain, seq, tenant, claim_id, repeat('0', 64) AS prev_hash, sha256(stem || '|' || repeat('0', 64)) AS entry_hash FROM placed WHERE seq = 1
UNION ALL SELECT p.chain, p.seq, p.tenant, p.claim_id, c.entry_hash, sha256(p.stem || '|' || c.entry_hash) FROM chained c JOIN placed p ON p.chain = c.chain AND p.seq = c.seq + 1"""


def entries(x) -> DataFrame:
    """The chains of a batch. Its rows are read twice, for their number per tenant and for themselves."""
    return ledger.chain_append(b.staged(x, ledger_rows(x), "ledger-rows"), "b1")


@case("L1", f"SELECT {', '.join(_LED)}, packet_digest FROM ledger_rows")
def l1(x):
    return ledger_rows(x).select(*_LED, "packet_digest")


@case("SNK6", "SELECT chain, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM placed GROUP BY chain")
def snk6(x):
    return ledger.assign_chains(b.staged(x, ledger_rows(x), "ledger-rows"), "b1").groupBy("chain").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").cast("bigint").alias("first_seq"), F.max("seq").cast("bigint").alias("last_seq"))


@case("L2", "SELECT chain, seq, tenant, claim_id, prev_hash, entry_hash FROM chained")
def l2(x):
    return entries(x).select("chain", F.col("seq").cast("bigint").alias("seq"), *K, "prev_hash", "entry_hash")


# Tampering: entry 3 of every chain is edited, entry 2 of the chains ending in 1 is gone.
@case("L3", """SELECT chain, count(*) - CASE WHEN chain LIKE '%1' AND count(*) >= 2 THEN 1 ELSE 0 END AS entries,
 NOT (count(*) >= 3 OR (chain LIKE '%1' AND count(*) >= 3)) AS ok, CASE WHEN count(*) >= 3 THEN 3 END AS broken_at,
 CASE WHEN count(*) < 3 THEN NULL WHEN chain LIKE '%1' THEN 'prev_hash does not match the entry before: an entry was removed or moved'
 ELSE 'entry_hash does not match the content: the entry was changed afterwards' END AS reason FROM placed GROUP BY chain""")
def l3(x):
    touched = entries(x).where(~(F.col("chain").endswith("1") & (F.col("seq") == 2))).withColumn(
        "settlement_paise", F.col("settlement_paise") + F.when(F.col("seq") == 3, 1).otherwise(0))
    return ledger.verify_chain(touched).select("chain", "entries", "ok", F.col("broken_at").cast("bigint").alias("broken_at"), "reason")


@case("L4", "SELECT chain, seq, entry_hash AS head FROM chained QUALIFY row_number() OVER (PARTITION BY chain ORDER BY seq DESC) = 1")
def l4(x):
    return ledger.heads(entries(x)).select("chain", F.col("seq").cast("bigint").alias("seq"), "head")


@case("L3M", """SELECT chain, CASE WHEN n = 1 AND chain LIKE '%2' OR chain LIKE '%3' THEN 'the chain is listed but has no entries' ELSE 'the chain ends before its listed end' END AS reason
 FROM (SELECT chain, count(*) AS n FROM placed GROUP BY chain) WHERE chain LIKE '%2' OR chain LIKE '%3'""")
def l3m(x):
    """The last entry of the chains ending in 2 and all of those ending in 3 are gone; the chains alone would still verify."""
    made = b.staged(x, entries(x), "ledger")
    listed = ledger.manifest(made, "b1")
    last = F.col("seq") == F.col("entries")
    left = made.join(listed.select("chain", "entries"), "chain").where(~(F.col("chain").endswith("3") | (F.col("chain").endswith("2") & last)))
    return ledger.verify_manifest(left.drop("entries"), listed)


# Anchors: every tenant's chains stand for a batch.
CTES["m_leaf"] = """SELECT split_part(chain, '/', 1) AS batch, sha256(chain || '|' || count(*) || '|' || arg_max(entry_hash, seq)) AS leaf, count(*) AS entries FROM chained GROUP BY chain"""
CTES["m_six"] = """SELECT batch, left(leaf, 6) AS path, sha256(string_agg(leaf, '|' ORDER BY leaf)) AS h, count(*) AS chains, sum(entries) AS entries FROM m_leaf GROUP BY batch, left(leaf, 6)"""
for _width, _from, _to in ((4, "m_six", "m_four"), (2, "m_four", "m_two"), (0, "m_two", "m_none")):
    CTES[_to] = f"""SELECT batch, left(path, {_width}) AS path, sha256(string_agg(path || ':' || h, '|' ORDER BY path || ':' || h)) AS h, sum(chains) AS chains, sum(entries) AS entries
 FROM {_from} GROUP BY batch, left(path, {_width})"""
CTES["m_roots"] = """SELECT row_number() OVER (ORDER BY batch) AS number, batch, CAST(chains AS BIGINT) AS chains, CAST(entries AS BIGINT) AS entries, h AS root FROM m_none"""
CTES["m_anchors"] = """
SELECT *, repeat('0', 64) AS prev_anchor, sha256(concat_ws('|', number, batch, chains, entries, root, repeat('0', 64))) AS anchor FROM m_roots WHERE number = 1
UNION ALL SELECT r.*, a.anchor, sha256(concat_ws('|', r.number, r.batch, r.chains, r.entries, r.root, a.anchor)) FROM m_anchors a JOIN m_roots r ON r.number = a.number + 1"""


def listed(x) -> DataFrame:
    return ledger.manifest(entries(x), "b1").withColumn("batch", F.split("chain", "/")[0])


@case("L2A", "SELECT number, batch, chains, entries, root, prev_anchor, anchor FROM m_anchors")
def l2a(x):
    return anchors.anchor_batches(listed(x))


@case("L3A", """SELECT number, batch, CASE WHEN gone + 1 = number THEN 'the anchor before is missing: a batch was removed'
 WHEN chains = 1 THEN 'the batch is anchored but none of its chains is listed' ELSE 'the chains listed for the batch are not those anchored' END AS reason
 FROM (SELECT *, max(CASE WHEN batch = 'T1' THEN number END) OVER () AS gone, max(number) OVER () AS last FROM m_roots) WHERE batch <> 'T1' AND (number = gone + 1 OR number = last)""")
def l3a(x):
    """All of batch T1 is gone, its manifest and its anchor too; the last batch has lost its first chain. Manifest and chains still verify."""
    whole = sized(listed(x))  # a manifest is a table that is kept; computed, it takes the whole audit every time it is read
    made = anchors.anchor_batches(whole)
    last = whole.groupBy().agg(F.max("batch").alias("last"))
    left = whole.where("batch <> 'T1'").join(last, (F.col("batch") == F.col("last")) & F.col("chain").endswith("/0"), "left_anti")
    return anchors.verify_anchors(left, made.where("batch <> 'T1'"))


@case("FL8", f"""SELECT p.chain, p.seq, p.claim_id, p.verdict, {b.decimal_text('gross_paise', 2)} AS gross FROM placed p WHERE tenant = 'T1' ORDER BY recorded_at DESC, chain DESC, seq DESC LIMIT 9999""")
def fl8(x):
    return ledger.history(entries(x), tenant="T1", limit=9999).select("chain", F.col("seq").cast("bigint").alias("seq"), "claim_id", "verdict", F.col("gross").cast("string").alias("gross"))


# --- retention ---------------------------------------------------------------------

_DAY = dt.date(2000, 6, 1)
CTES["expired"] = "SELECT tenant, claim_id FROM s_claims WHERE audited_at < TIMESTAMP '2000-06-01' - INTERVAL 730 DAY"


@case("L5", """SELECT (SELECT count(*) FROM expired) AS claims_deleted, (SELECT count(*) FROM s_findings f SEMI JOIN expired e ON e.tenant = f.tenant AND e.claim_id = f.claim_id) AS findings_deleted,
 (SELECT count(*) FROM s_gaps f SEMI JOIN expired e ON e.tenant = f.tenant AND e.claim_id = f.claim_id) AS gaps_deleted, 0 AS traces_deleted, '1998-06-02' AS cutoff, TRUE AS dry_run""")
def l5(x):
    return retention.purge_report(x.store, _DAY)


@case("J13", "SELECT tenant, claim_id, line_no FROM s_findings f ANTI JOIN expired e ON e.tenant = f.tenant AND e.claim_id = f.claim_id")
def j13(x):
    return retention.purge_expired(x.store, _DAY).findings.select(*K, "line_no")


CTES["erasures"] = "SELECT tenant, claim_id FROM claims0 WHERE k % 5 = 0"


@case("L6", """SELECT 'left' AS part, count(*) AS n FROM s_findings f ANTI JOIN erasures e ON e.tenant = f.tenant AND e.claim_id = f.claim_id
 UNION ALL SELECT 'tombstones', count(*) FROM erasures UNION ALL SELECT 'broken', 0""")
def l6(x):
    requests = x.claims.where(F.substring("claim_id", 5, 20).cast("bigint") % 5 == 0).unionByName(x.claims.limit(0)).select(*K)
    left, tombs = retention.erase_claims(x.store, requests, F.lit("2026-01-01T00:00:00+00:00"), "erase-1")
    count = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return count(left.findings, "left").unionByName(count(tombs, "tombstones")).unionByName(count(ledger.verify_entries(tombs), "broken"))
