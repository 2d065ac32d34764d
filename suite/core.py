"""Cases for classification, waterfall, checklist, checks, verification and the audit itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.functions import vocabulary as voc
from auditlens.operators import assess, checks, classify, documents, facts, waterfall
from suite import base as b
from suite.base import CTES, case

K = ["tenant", "claim_id"]

# --- classification ----------------------------------------------------------


@case("C1", "SELECT DISTINCT h.text, h.alias, h.chunk_id, CAST(length(h.alias) AS BIGINT) AS alias_len FROM alias_hits h")
def c1(x):
    return classify.alias_matches(classify.other_texts(x.lines), x.rules).select(
        "text", "alias", "chunk_id", F.col("alias_len").cast("bigint").alias("alias_len")).distinct()


CTES["v_keyword"] = "SELECT text, CASE WHEN classification = 'UNMAPPED' THEN 'PAYABLE' ELSE classification END AS classification, chunk_id, 'keyword' AS source FROM verdicts"
CTES["f_keyword"] = b.findings_sql("v_keyword", "keyword")
CTES["v_head_only"] = "SELECT text, 'LIST_II_ROOM' AS classification, NULL::VARCHAR AS chunk_id, 'keyword' AS source FROM texts"
CTES["f_head_only"] = b.findings_sql("v_head_only", "keyword")
# Letter-count vectors and the fused top five, written out once more in SQL.
_LETTERS = "[" + ", ".join(f"length({{t}}) - length(replace({{t}}, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz") + "]::DOUBLE[]"


def letter_sql(text: str) -> str:
    return _LETTERS.replace("{t}", f"lower({text})")


CTES["rule_docs"] = f"""SELECT chunk_id AS doc_id, path || '#' || lpad(CAST(pos AS VARCHAR), 9, '0') AS doc_order,
 title || '. ' || array_to_string(aliases, ' ') || '. ' || body AS text, list_name, title FROM rules"""
CTES["rule_vecs"] = f"SELECT doc_id, {letter_sql('text')} AS vec FROM rule_docs"


def bm25_ctes(p: str, queries: str, docs: str) -> None:
    """BM25 with the usual constants; a word in more than half of the documents gets a quarter of the mean weight."""
    CTES[f"{p}_tok"] = f"SELECT doc_id, doc_order, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {docs}"
    CTES[f"{p}_tf"] = f"SELECT doc_id, doc_order, term, count(*) AS tf FROM {p}_tok GROUP BY ALL"
    CTES[f"{p}_dl"] = f"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM {docs}"
    CTES[f"{p}_st"] = f"SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM {p}_dl"
    CTES[f"{p}_raw"] = f"SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {p}_tf, {p}_st GROUP BY term, n"
    CTES[f"{p}_idf"] = f"SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}_raw) ELSE raw END AS idf FROM {p}_raw"
    CTES[f"{p}_q"] = f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {queries}) GROUP BY ALL"
    CTES[f"{p}_score"] = f"""
SELECT query_id, t.doc_id, doc_order, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
FROM {p}_q q JOIN {p}_tf t ON t.term = q.term JOIN {p}_idf i ON i.term = q.term JOIN {p}_dl d ON d.doc_id = t.doc_id, {p}_st
GROUP BY query_id, t.doc_id, doc_order HAVING round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) > 0"""
    CTES[f"{p}_bm25"] = f"""
SELECT query_id, doc_id, doc_order, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_order DESC) - 1 AS bm25_rank FROM {p}_score"""


def dense_ctes(p: str, qvecs: str, dvecs: str) -> None:
    """qvecs (query_id, vec), dvecs (doc_id, doc_order, vec)."""
    dot = "list_dot_product(q.vec, d.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(d.vec, d.vec)))"
    CTES[f"{p}_cos"] = f"SELECT query_id, doc_id, doc_order, round({dot}, 9) AS cosine FROM {qvecs} q, {dvecs} d"
    CTES[f"{p}_dense"] = f"""
SELECT query_id, doc_id, doc_order, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_order DESC) - 1 AS dense_rank FROM {p}_cos"""


def fuse_ctes(p: str) -> None:
    CTES[f"{p}_rrf"] = f"""
SELECT query_id, doc_id, min(br) AS bm25_rank, min(dr) AS dense_rank,
 round(COALESCE(1.0::DOUBLE / (60 + min(br)), 0) + COALESCE(1.0::DOUBLE / (60 + min(dr)), 0), 12) AS score FROM (
 SELECT query_id, doc_id, bm25_rank AS br, NULL AS dr FROM {p}_bm25 WHERE bm25_rank < 25
 UNION ALL SELECT query_id, doc_id, NULL, dense_rank FROM {p}_dense WHERE dense_rank < 25) GROUP BY query_id, doc_id"""
    CTES[f"{p}_top"] = f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST) AS rank FROM {p}_rrf
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST) <= 5"""


CTES["text_queries"] = "SELECT text AS query_id, text FROM texts"
CTES["text_vecs"] = f"SELECT text AS query_id, {letter_sql('text')} AS vec FROM texts"
CTES["rule_dvecs"] = "SELECT doc_id, doc_order, vec FROM rule_vecs JOIN rule_docs USING (doc_id)"
bm25_ctes("cr", "text_queries", "rule_docs")
dense_ctes("cr", "text_vecs", "rule_dvecs")
fuse_ctes("cr")
CTES["nearest"] = """
SELECT t.query_id AS text, t.doc_id AS chunk_id, d.list_name, c.cosine FROM cr_top t JOIN rule_docs d ON d.doc_id = t.doc_id
JOIN cr_cos c ON c.query_id = t.query_id AND c.doc_id = t.doc_id WHERE d.list_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY t.query_id ORDER BY c.cosine DESC, t.rank) = 1"""
CTES["v_retrieval"] = """
SELECT t.text, CASE WHEN n.cosine >= 0.82 THEN n.list_name ELSE 'PAYABLE' END AS classification,
 CASE WHEN n.cosine >= 0.82 THEN n.chunk_id END AS chunk_id, 'retrieval' AS source, n.cosine FROM texts t LEFT JOIN nearest n ON n.text = t.text"""
CTES["f_retrieval"] = b.findings_sql("v_retrieval", "retrieval")
CTES["v_determined"] = """
SELECT v.text, CASE WHEN v.classification <> 'UNMAPPED' THEN v.classification WHEN r.classification <> 'PAYABLE' THEN r.classification ELSE 'UNMAPPED' END AS classification,
 COALESCE(v.chunk_id, r.chunk_id) AS chunk_id, CASE WHEN v.classification <> 'UNMAPPED' THEN 'keyword' ELSE 'retrieval' END AS source
FROM verdicts v JOIN v_retrieval r ON r.text = v.text"""
CTES["f_determined"] = b.findings_sql("v_determined", "retrieval")

_F = ["tenant", "claim_id", "line_no", "classification", "bearer", "severity", "deducted_paise", "cited_chunk_id", "source"]
_FSQL = "SELECT " + ", ".join(_F) + " FROM "


@case("C2", _FSQL + "f_keyword")
def c2(x):
    return x.findings("keyword").select(*_F)


@case("C3", _FSQL + "f_head_only")
def c3(x):
    return x.findings("head_only").select(*_F)


@case("C4", _FSQL + "f_retrieval")
def c4(x):
    return x.findings("retrieval").select(*_F)


@case("C5", _FSQL + "f_determined")
def c5(x):
    return x.findings("deterministic").select(*_F)


# A model's verdict table derived from the lines: every tenth line unanswered, some citations missing or invented.
CTES["model_verdicts"] = """
SELECT l.tenant, l.claim_id, l.line_no, CASE (line_no // 1000) % 5 WHEN 0 THEN 'PAYABLE' WHEN 1 THEN 'LIST_II_ROOM' WHEN 2 THEN 'LIST_III_PROCEDURE'
  WHEN 3 THEN 'LIST_I_OPTIONAL' ELSE 'UNMAPPED' END AS classification,
 CASE (line_no // 1000) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NO-SUCH' WHEN 2 THEN 'PRO-01' WHEN 3 THEN 'PER-04' WHEN 4 THEN 'TRE-04' ELSE 'ROM-02' END AS cited,
 0.75 AS confidence FROM lines l WHERE (line_no // 1000) % 10 <> 9"""


def model_verdicts(x) -> DataFrame:
    n = F.expr("line_no div 1000")
    return x.lines.where(n % 10 != 9).select(
        *K, "line_no",
        F.when(n % 5 == 0, "PAYABLE").when(n % 5 == 1, "LIST_II_ROOM").when(n % 5 == 2, "LIST_III_PROCEDURE")
        .when(n % 5 == 3, "LIST_I_OPTIONAL").otherwise("UNMAPPED").alias("classification"),
        F.when(n % 7 == 0, None).when(n % 7 == 1, "NO-SUCH").when(n % 7 == 2, "PRO-01").when(n % 7 == 3, "PER-04")
        .when(n % 7 == 4, "TRE-04").otherwise("ROM-02").alias("cited_chunk_id"),
        F.lit("said by the model").alias("reason"), F.lit(0.75).alias("confidence"))


CTES["f_model"] = """
SELECT l.tenant, l.claim_id, l.line_no, l.amount_paise, v.classification AS proposed, r.chunk_id AS known,
 CASE WHEN v.classification IS NULL OR (v.classification LIKE 'LIST_%' AND r.chunk_id IS NULL) THEN 'UNMAPPED' ELSE v.classification END AS classification,
 CASE WHEN v.classification IS NULL OR (v.classification LIKE 'LIST_%' AND r.chunk_id IS NULL) THEN NULL ELSE r.chunk_id END AS cited_chunk_id,
 CASE WHEN v.classification IS NULL OR (v.classification LIKE 'LIST_%' AND r.chunk_id IS NULL) THEN 0 ELSE 75 END AS percent,
 CASE WHEN v.classification IS NULL THEN 'keyword' ELSE 'llm' END AS source, r.rule_bearer, r.rule_severity
FROM lines l LEFT JOIN model_verdicts v ON v.tenant = l.tenant AND v.claim_id = l.claim_id AND v.line_no = l.line_no
LEFT JOIN rule_facts r ON r.chunk_id = v.cited"""


def model_findings(x) -> DataFrame:
    return classify.apply_model_verdicts(x.lines, model_verdicts(x), x.rules, x.sources)


@case("C6", "SELECT tenant, claim_id, line_no, classification, cited_chunk_id, CAST(percent AS BIGINT) AS percent, source FROM f_model")
def c6(x):
    return model_findings(x).select(*K, "line_no", "classification", "cited_chunk_id", F.round(F.col("confidence") * 100).cast("bigint").alias("percent"), "source")


@case("C7", """SELECT tenant, claim_id, line_no, bearer, severity, deducted_paise, impact_paise, citation, source_id, COALESCE(cited_chunk_id, '') AS rule_id,
 description AS observed, CASE WHEN rule_title IS NULL THEN '' ELSE 'not billed on its own: ' || lower(rule_title) END AS expected FROM findings""")
def c7(x):
    return x.audit.findings.select(*K, "line_no", "bearer", "severity", "deducted_paise", "impact_paise", "citation", "source_id", "rule_id", "observed", "expected")


@case("C8", " UNION ALL ".join(f"SELECT '{s}' AS strategy, classification, source, count(*) AS n, CAST(sum(deducted_paise) AS BIGINT) AS deducted FROM {c} GROUP BY ALL"
      for s, c in (("head_only", "f_head_only"), ("keyword", "f_keyword"), ("retrieval", "f_retrieval"), ("deterministic", "f_determined"))))
def c8(x):
    parts = [x.findings(s).groupBy("classification", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("deducted_paise").alias("deducted"))
             .withColumn("strategy", F.lit(s)) for s in ("head_only", "keyword", "retrieval", "deterministic")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@case("C9", "SELECT tenant, claim_id, bool_or(source = 'llm') AS ai_used FROM f_model GROUP BY ALL")
def c9(x):
    return classify.ai_used(model_findings(x))


# --- joins that have no case of their own elsewhere ----------------------------


@case("J1", "SELECT l.tenant, l.claim_id, l.line_no, b.chunk_id, b.alias FROM lines l JOIN best_alias b ON l.head = 'OTHER' AND b.text = lower(l.description)")
def j1(x):
    best = classify.best_alias(classify.other_texts(x.lines), x.rules).select("text", "chunk_id", "alias")
    keyed = x.lines.where("head = 'OTHER'").select(*K, "line_no", F.lower("description").alias("text"))
    return classify.salted_left_join(keyed, best, "text", ["claim_id", "line_no"], how="inner").select(*K, "line_no", "chunk_id", "alias")


@case("J2", "SELECT f.tenant, f.claim_id, f.line_no, f.source_id, f.citation FROM findings f WHERE f.cited_chunk_id IS NOT NULL")
def j2(x):
    return x.audit.findings.where("cited_chunk_id is not null").select(*K, "line_no", "source_id", "citation")


@case("J3", "SELECT c.tenant, c.claim_id, p.profile, array_to_string(p.excluded, ',') AS excluded FROM claims0 c CROSS JOIN profiles p")
def j3(x):
    return waterfall.per_profile(x.claims).select(*K, "profile", F.array_join("excluded_heads", ",").alias("excluded"))


@case("J4", "SELECT tenant, claim_id, count(*) AS n, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM gaps GROUP BY ALL")
def j4(x):
    arr = documents.gap_array(x.audit.facts)
    return x.audit.facts.select(*K, F.transform(arr, lambda g: g["document_id"]).alias("d")).where(F.size("d") > 0).select(
        *K, F.size("d").cast("bigint").alias("n"), F.array_join(F.array_sort("d"), ",").alias("documents"))


@case("J5", "SELECT tenant, claim_id, line_no, classification AS proposed FROM model_verdicts v ANTI JOIN rule_facts r ON r.chunk_id = v.cited WHERE classification LIKE 'LIST_%'")
def j5(x):
    bad = model_verdicts(x).where(voc.is_listed(F.col("classification")))
    return bad.join(x.rules.select(F.col("chunk_id").alias("cited_chunk_id")), "cited_chunk_id", "left_anti").select(*K, "line_no", F.col("classification").alias("proposed"))


@case("J6", "SELECT tenant, claim_id, line_no FROM f_model WHERE proposed IS NULL")
def j6(x):
    return model_findings(x).where("source = 'keyword'").select(*K, "line_no")


@case("J7", "SELECT tenant, claim_id, ord, CAST(paise AS BIGINT) AS paise FROM unsupported")
def j7(x):
    a = x.kept_audit()
    bad = assess.unsupported_figures(b.narrative(a.facts), known(a))
    return bad.select(*K, F.col("ord").cast("bigint").alias("ord"), (F.col("value") * 100).cast("bigint").alias("paise"))


@case("J12", "SELECT tenant, claim_id, line_no, head, CAST(amount_paise AS BIGINT) AS amount_paise, CAST(deducted_paise AS BIGINT) AS deducted_paise FROM down_findings")
def j12(x):
    _, moved = waterfall.downgrade_lines(x.claims, x.audit.findings)
    return moved.select(*K, "line_no", "head", "amount_paise", "deducted_paise")


# --- waterfall -------------------------------------------------------------------


def wf(x) -> DataFrame:
    return x.audit.waterfall


@case("W1", "SELECT tenant, claim_id, CAST(patient_items AS BIGINT) AS patient_items, CAST(hospital_items AS BIGINT) AS hospital_items, CAST(gross_paise - patient_items - hospital_items AS BIGINT) AS running FROM facts")
def w1(x):
    return x.audit.facts.select(*K, "patient_items", "hospital_items", (F.col("gross_paise") - F.col("patient_items") - F.col("hospital_items")).alias("running"))


_HEADS = [f"payable_{h.lower()}" for h in voc.HEADS]


@case("W2", "SELECT tenant, claim_id, " + ", ".join(f"CAST({h} AS BIGINT) AS {h}" for h in _HEADS) + " FROM facts")
def w2(x):
    return x.audit.facts.select(*K, *_HEADS)


@case("W3", "SELECT tenant, claim_id, profile, CAST(assoc AS BIGINT) AS associated_paise FROM wf0")
def w3(x):
    return wf(x).select(*K, "profile", "associated_paise")


def step_case(key: str, step: str, col: str) -> None:
    @case(key, f"SELECT tenant, claim_id, profile, CAST({col} AS BIGINT) AS taken_paise FROM wf")
    def _(x):
        return wf(x).select(*K, "profile", F.col(f"{step}_taken").alias("taken_paise"))


for _key, _step, _col in (("W4", "room_rent_excess", "s1"), ("W5", "room_rent_proportionate", "s2"), ("W6", "procedure_sublimit", "s3"),
                          ("W7", "deductible", "s4"), ("W8", "copay", "s5"), ("W9", "sum_insured_cap", "s6")):
    step_case(_key, _step, _col)

_MONEY = ["gross_paise", "settlement_paise", "patient_paise", "hospital_paise"]


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


@case("W10", f"SELECT tenant, claim_id, profile, {big(*_MONEY)} FROM wf")
def w10(x):
    return wf(x).select(*K, "profile", *_MONEY)


_STEP_UNION = " UNION ALL ".join(
    f"SELECT tenant, claim_id, profile, {i} AS step_no, '{s}' AS step, CAST(s{i} AS BIGINT) AS taken_paise, CAST({w} AS BIGINT) AS wanted_paise FROM wf WHERE s{i} > 0"
    for i, (s, w) in enumerate((("room_rent_excess", "w1"), ("room_rent_proportionate", "w2"), ("procedure_sublimit", "s3"),
                                ("deductible", "deductible_paise"), ("copay", "s5"), ("sum_insured_cap", "s6")), 1))
CTES["steps"] = _STEP_UNION


def _rs(c: str) -> str:
    """'Rs 1,234.50' from paise."""
    p = f"CAST({c} AS BIGINT)"
    return f"('Rs ' || CASE WHEN {p} < 0 THEN '-' ELSE '' END || format('{{:,}}', abs({p}) // 100) || '.' || lpad(CAST(abs({p}) % 100 AS VARCHAR), 2, '0'))"


def _inputs(*pairs: tuple[str, str]) -> str:
    return " || '; ' || ".join(f"'{name}=' || {value}" for name, value in pairs)


# Steps as they are printed: number, wanted, before, basis, inputs.
_PCT = "CAST(CAST(copay_pct AS DECIMAL(9,2)) AS VARCHAR) || '%'"
_LIMIT = "CASE WHEN k % 4 = 0 THEN 'knee replacement' WHEN b2 > 15000000 THEN 'bypass' ELSE 'graft' END"
_PRINTED = (
    ("room_rent_excess", "w1", "b0", f"'Room at ' || {_rs('rate_paise')} || ' a day, limit ' || {_rs('cap')} || ' a day, ' || room_days || ' days.'",
     _inputs(("rate per day", _rs("rate_paise")), ("limit per day", _rs("cap")), ("days", "room_days"), ("room charges on the claim", _rs("payable_room")))),
    ("room_rent_proportionate", "w2", "b1",
     f"'Associated charges of ' || {_rs('assoc')} || ' cut by 1 - ' || {_rs('cap')} || ' / ' || {_rs('rate_paise')} || ' under profile ' || profile || '.'",
     _inputs(("associated charges", _rs("assoc")), ("heads left out", "array_to_string(list_sort(list_append(excluded, 'ROOM')), ', ')"))),
    ("procedure_sublimit", "s3", "b2", f"'Sub-limit for ' || {_LIMIT} || ': ' || {_rs('b2 - s3')} || '.'",
     _inputs(("procedure", "COALESCE(procedure, '')"), ("sub-limit", _rs("b2 - s3")))),
    ("deductible", "deductible_paise", "b3", f"'Deductible of ' || {_rs('deductible_paise')} || '.'", _inputs(("deductible", _rs("deductible_paise")))),
    ("copay", "s5", "b4", f"'Co-pay of ' || {_PCT} || ' on ' || {_rs('b4')} || '.'", _inputs(("rate", _PCT), ("admissible", _rs("b4")))),
    ("sum_insured_cap", "s6", "b5", f"'Sum insured left: ' || {_rs('balance_paise')} || '.'",
     _inputs(("sum insured left", _rs("balance_paise")), ("claim at this step", _rs("b5")))))
CTES["printed_steps"] = " UNION ALL ".join(
    f"""SELECT tenant, claim_id, profile, {i} AS step_no, '{s}' AS step, CAST(s{i} AS BIGINT) AS taken_paise, CAST({w} AS BIGINT) AS wanted_paise, s{i} <> {w} AS clamped, {basis} AS basis,
 {given} || CASE WHEN s{i} <> {w} THEN '; clamped=computed ' || {_rs(w)} || ', left ' || {_rs(before)} ELSE '' END AS inputs,
 'min(' || {_rs(w)} || ', ' || {_rs(before)} || ') = ' || {_rs(f's{i}')} AS formula FROM wf JOIN profiles USING (profile) WHERE s{i} > 0"""
    for i, (s, w, before, basis, given) in enumerate(_PRINTED, 1))


@case("W11", "SELECT * FROM printed_steps")
def w11(x):
    rows = waterfall.deduction_rows(wf(x))
    inputs = F.array_join(F.transform(F.map_entries("inputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return rows.select(*K, "profile", "step_no", "step", "taken_paise", "wanted_paise", "clamped", "basis", inputs.alias("inputs"), "formula")


@case("W12", "SELECT profile, count(*) AS n, CAST(count(*) FILTER (settlement_paise + patient_paise + hospital_paise <> gross_paise) AS BIGINT) AS broken FROM wf GROUP BY profile")
def w12(x):
    bad = F.col("settlement_paise") + F.col("patient_paise") + F.col("hospital_paise") != F.col("gross_paise")
    return wf(x).groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("broken"))


CTES["ranges"] = """SELECT tenant, claim_id, CAST(min(settlement_paise) AS BIGINT) AS low_paise, CAST(max(settlement_paise) AS BIGINT) AS high_paise,
 CAST(max(settlement_paise) FILTER (profile = 'typical') AS BIGINT) AS typical_paise FROM wf GROUP BY tenant, claim_id"""


@case("W13", "SELECT * FROM ranges")
def w13(x):
    return waterfall.settlement_range(wf(x))


CTES["over_cap"] = "SELECT *, CASE WHEN is_icu THEN icu_cap_paise ELSE room_cap_paise END AS new_rate FROM claims0 WHERE rate_paise > CASE WHEN is_icu THEN icu_cap_paise ELSE room_cap_paise END"
CTES["down_claims"] = "SELECT * EXCLUDE (new_rate) REPLACE (new_rate AS rate_paise) FROM over_cap"
CTES["down_findings"] = """
SELECT f.* REPLACE (CASE WHEN f.head = 'ROOM' AND CASE WHEN f.unit_rate_paise > 0 THEN f.unit_rate_paise = o.rate_paise
 WHEN f.quantity > 0 THEN f.amount_paise = o.rate_paise * f.quantity ELSE f.amount_paise = o.rate_paise END
 THEN f.amount_paise - (o.rate_paise - o.new_rate) * f.quantity ELSE f.amount_paise END AS amount_paise)
FROM findings f JOIN over_cap o ON o.tenant = f.tenant AND o.claim_id = f.claim_id"""
CTES["down_facts0"] = b.facts_sql("down_claims", "down_findings")
CTES["down_facts"] = b._ZEROED + "down_facts0"
b.waterfall_ctes("dw", "down_facts")


@case("W14", f"""SELECT d.tenant, d.claim_id, CAST(d.gross_paise AS BIGINT) AS gross_paise, CAST(d.settlement_paise AS BIGINT) AS settlement_paise,
 CAST(d.settlement_paise - w.settlement_paise AS BIGINT) AS gain_paise
 FROM dw d JOIN wf w ON w.tenant = d.tenant AND w.claim_id = d.claim_id AND w.profile = d.profile WHERE d.profile = 'typical'""")
def w14(x):
    return waterfall.simulate_room_downgrade(x.claims, x.audit.findings).select(*K, "gross_paise", "settlement_paise", "gain_paise")


# --- checklist and checks ---------------------------------------------------------


@case("D1", f"SELECT tenant, claim_id, document_id, name, severity, row_number() OVER (PARTITION BY tenant, claim_id ORDER BY {b.SEV}, n) - 1 AS ord FROM gaps")
def d1(x):
    return x.audit.gaps.select(*K, "document_id", "name", "severity", F.col("ord").cast("bigint").alias("ord"))


def gap_case(key: str, doc: str) -> None:
    @case(key, f"SELECT tenant, claim_id, severity FROM gaps WHERE document_id = '{doc}'")
    def _(x):
        return x.audit.gaps.where(F.col("document_id") == doc).select(*K, "severity")


for _i, (_doc, _, _) in enumerate(documents.REQUIREMENTS):
    gap_case(f"D{_i + 2}", _doc)


def check_case(key: str, check: str) -> None:
    @case(key, f"SELECT tenant, claim_id, severity, impact_paise FROM flags WHERE check_id = '{check}'")
    def _(x):
        return x.audit.flags.where(F.col("check_id") == check).select(*K, "severity", "impact_paise")


for _i, (_check, _) in enumerate(checks.CHECKS):
    if _check != "CHK-DATE-WINDOW":
        check_case(f"K{_i + 1}", _check)


@case("K3", """SELECT tenant, claim_id, CAST(sum(n_out) AS BIGINT) AS n_outside, CAST(sum(paise) AS BIGINT) AS outside_paise,
 array_to_string(list_slice(list(line_no ORDER BY line_no), 1, 8), ',') AS first_lines FROM (
 SELECT tenant, claim_id, line_no, count(*) FILTER (outside_stay) AS n_out, sum(amount_paise) AS paise FROM lines GROUP BY ALL HAVING count(*) FILTER (outside_stay) > 0)
 GROUP BY tenant, claim_id""")
def k3(x):
    return checks.lines_outside_stay(x.lines).select(*K, "n_outside", "outside_paise", F.array_join("first_lines", ",").alias("first_lines"))


@case("K10", f"SELECT tenant, claim_id, check_id, severity, impact_paise, row_number() OVER (PARTITION BY tenant, claim_id ORDER BY {b.SEV}, reg) - 1 AS ord FROM flags")
def k10(x):
    return x.audit.flags.select(*K, "check_id", "severity", "impact_paise", F.col("ord").cast("bigint").alias("ord"))


# --- verification, assessment, audit ------------------------------------------------


@case("V1", "SELECT tenant, claim_id, profile, CAST(settlement_paise + patient_paise + hospital_paise - gross_paise AS BIGINT) AS difference FROM wf")
def v1(x):
    return wf(x).select(*K, "profile", (F.col("settlement_paise") + F.col("patient_paise") + F.col("hospital_paise") - F.col("gross_paise")).alias("difference"))


@case("V2", "SELECT tenant, claim_id, count(*) || ' deduction(s) cite no rule.' AS problem FROM f_head_only WHERE classification LIKE 'LIST_%' GROUP BY tenant, claim_id")
def v2(x):
    return assess.uncited_deductions(x.findings("head_only"))


CTES["figures"] = """
SELECT tenant, claim_id, unnest([gross_paise, settlement_paise, patient_paise, hospital_paise, patient_items + hospital_items]::BIGINT[]) AS paise FROM wf
UNION ALL SELECT tenant, claim_id, taken_paise FROM steps
UNION ALL SELECT tenant, claim_id, unnest([amount_paise, deducted_paise]::BIGINT[]) FROM findings
UNION ALL SELECT tenant, claim_id, unnest([rate_paise, COALESCE(room_cap_paise, 0), sum_insured_paise, balance_paise]::BIGINT[]) FROM facts
UNION ALL SELECT tenant, claim_id, unnest([preauth_paise, abs(gross_paise - preauth_paise)]::BIGINT[]) FROM facts WHERE preauth_paise <> 0"""
# Figures that only messages print, without their sign; under a thousand rupees a number in a text is none.
CTES["extra_figures"] = """
SELECT tenant, claim_id, unnest([room_billed, rate_paise * room_days]::BIGINT[]) AS paise FROM checks_wide WHERE room_billed <> 0 AND room_gap > 100
UNION ALL SELECT tenant, claim_id, unmapped_paise FROM facts WHERE gross_paise > 0 AND unmapped_paise * 10 > gross_paise
UNION ALL SELECT tenant, claim_id, cap FROM wf WHERE s1 + s2 > 0 UNION ALL SELECT tenant, claim_id, assoc FROM wf WHERE s2 > 0
UNION ALL SELECT tenant, claim_id, b4 FROM wf WHERE s5 > 0 UNION ALL SELECT tenant, claim_id, deductible_paise FROM wf WHERE s4 > 0
UNION ALL SELECT tenant, claim_id, b2 - s3 FROM wf WHERE s3 > 0"""
CTES["printed"] = "SELECT tenant, claim_id, abs(paise) AS paise FROM extra_figures WHERE abs(paise) >= 100000"
# Whole rupees of a paise amount, half-even.
CTES["known"] = f"""
SELECT DISTINCT tenant, claim_id, unnest([paise, CAST({b.half_even('paise', '100')} * 100 AS BIGINT)]) AS value FROM (
 SELECT tenant, claim_id, paise FROM figures UNION ALL SELECT * FROM printed)"""


def known(a) -> assess.Known:
    """With the claim's own waterfall and messages, worked out in its row."""
    return assess.known_figures(a.facts, None, a.findings, None)


@case("V3", "SELECT tenant, claim_id, value AS paise FROM known")
def v3(x):
    return known(x.kept_audit()).values()


# A caller's narrative of most claims: the bill, an invented figure, a round one, one that only a message prints, and one of the header.
CTES["quoted0"] = """
SELECT tenant, claim_id, unnest([1, 2, 3, 4, 5]) AS n, unnest([gross_paise, gross_paise + 12300, 100000 * room_days, room_billed, balance_paise]::BIGINT[]) AS paise
FROM facts WHERE room_days % 4 <> 0"""
CTES["quoted"] = "SELECT *, row_number() OVER (PARTITION BY tenant, claim_id ORDER BY n) - 1 AS ord FROM quoted0 WHERE abs(paise) >= 100000"


CTES["unsupported"] = f"""
SELECT tenant, claim_id, ord, abs(paise) AS paise FROM quoted u WHERE TRUE
 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.tenant = u.tenant AND k.claim_id = u.claim_id AND k.value = abs(u.paise))
 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.tenant = u.tenant AND k.claim_id = u.claim_id AND k.value = {b.half_even('abs(u.paise)', '100')} * 100)"""


@case("V4", "SELECT tenant, claim_id, CAST(paise AS BIGINT) AS paise, count(*) AS n FROM unsupported GROUP BY ALL")
def v4(x):
    a = x.kept_audit()
    bad = assess.unsupported_figures(b.narrative(a.facts), known(a))
    return bad.groupBy(*K, (F.col("value") * 100).cast("bigint").alias("paise")).agg(F.count(F.lit(1)).alias("n"))


@case("V5", f"""SELECT c.tenant, c.claim_id, u.claim_id IS NULL AS verify_passed,
 COALESCE(u.n || ' figure(s) in the text were never computed, such as ' || u.example, '') AS problems
FROM claims0 c LEFT JOIN (SELECT tenant, claim_id, count(*) AS n, min(format('{{:,}}', paise // 100) || '.' || lpad(CAST(paise % 100 AS VARCHAR), 2, '0')) AS example
 FROM unsupported GROUP BY ALL) u ON u.tenant = c.tenant AND u.claim_id = c.claim_id""")
def v5(x):
    a = x.kept_audit()
    out = assess.verify(x.claims, a.waterfall, a.findings, assess.unsupported_figures(b.narrative(a.facts), known(a)))
    return out.select(*K, "verify_passed", F.array_join("problems", "|").alias("problems"))


CTES["coverage"] = f"""
SELECT tenant, claim_id, CASE WHEN gross_paise > 0 THEN {b.half_even('(gross_paise - unmapped_paise - unsure_paise) * 1000', 'gross_paise')} ELSE 1000 END AS milli,
 gross_paise > 0 AND (gross_paise - unmapped_paise - unsure_paise) * 10 < gross_paise * 9 AS low, unmapped_paise + unsure_paise AS unassessed, n_unmapped, n_unsure FROM facts"""


@case("A1", f"SELECT tenant, claim_id, {b.decimal_text('milli', 3)} AS coverage, CAST(unassessed AS BIGINT) AS unassessed FROM coverage")
def a1(x):
    return x.audit.facts.select(*K, assess.coverage(3).cast("string").alias("coverage"), assess.unassessed().alias("unassessed"))


@case("A2", "SELECT tenant, claim_id, CAST(n_unmapped AS BIGINT) AS n_unmapped, CAST(n_unsure AS BIGINT) AS n_unsure FROM coverage WHERE low")
def a2(x):
    return x.audit.facts.where(assess.caveat().isNotNull()).select(*K, "n_unmapped", "n_unsure")


@case("A3", "SELECT c.tenant, c.claim_id, d.ord FROM claims0 c, (VALUES (0), (1), (2)) AS d(ord)")
def a3(x):
    return assess.disclosures(x.audit.facts, x.rules, x.sources, b.TODAY).select(*K, "ord")


CTES["merged"] = f"""
SELECT tenant, claim_id, 0 AS kind, line_no AS pos, COALESCE(cited_chunk_id, '') AS rule_id, severity, impact_paise FROM findings WHERE classification <> 'PAYABLE'
UNION ALL SELECT tenant, claim_id, 1, row_number() OVER (PARTITION BY tenant, claim_id ORDER BY {b.SEV}, n) - 1, document_id, severity, NULL FROM gaps
UNION ALL SELECT tenant, claim_id, 2, row_number() OVER (PARTITION BY tenant, claim_id ORDER BY {b.SEV}, reg) - 1, check_id, severity, impact_paise FROM flags"""


def merged(x) -> DataFrame:
    return assess.all_findings(x.audit.findings, x.audit.gaps, x.audit.flags)


@case("A4", f"SELECT tenant, claim_id, kind, pos AS position, rule_id, severity, CAST(impact_paise AS BIGINT) AS impact_paise, {b.SEV} AS severity_rank FROM merged")
def a4(x):
    return merged(x).select(*K, "kind", "position", "rule_id", "severity", "impact_paise", "severity_rank")


# The narrative of a claim drops signs; a negative figure needs another figure or line of its size.
CTES["wf_narrated"] = """
SELECT f.tenant, f.claim_id, unnest([f.gross_paise, r.low_paise, r.high_paise, w.patient_paise, w.hospital_paise]::BIGINT[]) AS p
FROM facts f JOIN ranges r ON r.tenant = f.tenant AND r.claim_id = f.claim_id
JOIN wf w ON w.tenant = f.tenant AND w.claim_id = f.claim_id AND w.profile = 'typical'"""
CTES["unverified"] = f"""
SELECT DISTINCT tenant, claim_id FROM wf_narrated u WHERE p <= -100000 AND NOT EXISTS (
 SELECT 1 FROM (SELECT * FROM figures UNION ALL SELECT * FROM printed) k WHERE k.tenant = u.tenant AND k.claim_id = u.claim_id
 AND {b.half_even('k.paise', '100')} = {b.half_even('abs(u.p)', '100')})"""
def audits_sql(unverified: str) -> str:
    return f"""
SELECT f.tenant, f.claim_id, f.month, f.discharge_date, f.admission_date, f.diagnosis, f.procedure, f.k, {", ".join(f"CAST(w.{n} AS BIGINT) AS {n}" for n in _MONEY)}, r.low_paise, r.high_paise,
 CAST(w.room_rent_paise AS BIGINT) AS room_rent_paise, CAST(f.n_unmapped AS BIGINT) AS unmapped_count, COALESCE(g.n, 0) AS doc_gap_count,
 CAST(f.n_items + COALESCE(g.n, 0) + COALESCE(x.n, 0) AS BIGINT) AS finding_count, {b.decimal_text('c.milli', 3)} AS coverage, u.claim_id IS NULL AS verify_passed,
 CASE WHEN c.low OR u.claim_id IS NOT NULL THEN 'CANNOT_VERIFY' WHEN f.n_items + COALESCE(g.n, 0) + COALESCE(x.n, 0) > 0 THEN 'NEEDS_ATTENTION' ELSE 'CLEAN' END AS verdict
FROM facts f JOIN wf w ON w.tenant = f.tenant AND w.claim_id = f.claim_id AND w.profile = 'typical'
JOIN ranges r ON r.tenant = f.tenant AND r.claim_id = f.claim_id JOIN coverage c ON c.tenant = f.tenant AND c.claim_id = f.claim_id
LEFT JOIN (SELECT tenant, claim_id, count(*) AS n FROM gaps GROUP BY ALL) g ON g.tenant = f.tenant AND g.claim_id = f.claim_id
LEFT JOIN (SELECT tenant, claim_id, count(*) AS n FROM flags GROUP BY ALL) x ON x.tenant = f.tenant AND x.claim_id = f.claim_id
LEFT JOIN {unverified} u ON u.tenant = f.tenant AND u.claim_id = f.claim_id"""


CTES["audits"] = audits_sql("unverified")
# Claims with a caller's narrative are verified by it, the others by the standard one.
CTES["unverified_told"] = """SELECT DISTINCT tenant, claim_id FROM unsupported
UNION ALL SELECT u.tenant, u.claim_id FROM unverified u ANTI JOIN quoted0 q ON q.tenant = u.tenant AND q.claim_id = u.claim_id"""
CTES["audits_told"] = audits_sql("unverified_told")


@case("A5", "SELECT tenant, claim_id, verify_passed, verdict FROM audits_told")
def a5(x):
    return x.told().audits.select(*K, "verify_passed", "verdict")


@case("A6", "SELECT tenant, claim_id, unmapped_count, doc_gap_count FROM audits")
def a6(x):
    return x.audit.audits.select(*K, "unmapped_count", "doc_gap_count")


_AUDIT = ["month", "diagnosis", "procedure", *_MONEY, "low_paise", "high_paise", "room_rent_paise", "unmapped_count", "doc_gap_count", "finding_count", "verify_passed", "verdict"]


@case("A7", f"SELECT tenant, claim_id, {', '.join(_AUDIT)}, coverage FROM audits_told")
def a7(x):
    return x.told().audits.select(*K, *_AUDIT, F.col("coverage").cast("string").alias("coverage"))


@case("A8", """SELECT tenant, claim_id, section, count(*) AS n, CAST(sum(position) AS BIGINT) AS positions FROM (
 SELECT tenant, claim_id, 1 AS section, step_no AS position FROM steps WHERE profile = 'typical'
 UNION ALL SELECT tenant, claim_id, 2, line_no FROM findings WHERE bearer = 'HOSPITAL' UNION ALL SELECT tenant, claim_id, kind + 2, pos FROM merged WHERE kind > 0
 UNION ALL SELECT tenant, claim_id, 5, line_no FROM findings WHERE classification = 'UNMAPPED') GROUP BY ALL""")
def a8(x):
    a = x.audit
    return assess.action_list(a.waterfall, a.findings, a.gaps, a.flags).groupBy(*K, "section").agg(
        F.count(F.lit(1)).alias("n"), F.sum("position").alias("positions"))


_RUP = lambda c: b.decimal_text(c, 2)


@case("A9", f"""SELECT tenant, claim_id, section, position, money FROM (
 SELECT tenant, claim_id, 'claim' AS section, 0 AS position, {_RUP('gross_paise')} AS money FROM facts
 UNION ALL SELECT tenant, claim_id, 'policy_deduction', step_no, {_RUP('taken_paise')} FROM steps WHERE profile = 'typical'
 UNION ALL SELECT tenant, claim_id, 'deducted_item', line_no, {_RUP('amount_paise')} FROM findings WHERE deducted_paise > 0
 UNION ALL SELECT tenant, claim_id, 'unmapped_item', line_no, NULL FROM findings WHERE classification = 'UNMAPPED'
 UNION ALL SELECT tenant, claim_id, CASE kind WHEN 1 THEN 'missing_document' ELSE 'consistency_flag' END, pos, NULL FROM merged WHERE kind > 0)""")
def a9(x):
    a = x.audit
    out = assess.facts_bundle(a.facts, a.waterfall, a.findings, a.gaps, a.flags)
    return out.select(*K, "section", "position", F.coalesce(F.get_json_object("fact", "$.gross_bill"), F.get_json_object("fact", "$.amount")).alias("money"))


@case("A10", "SELECT tenant, claim_id, severity, count(*) AS n FROM merged GROUP BY ALL")
def a10(x):
    return assess.severity_counts(merged(x))
