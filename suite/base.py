"""Shared ground of all cases: lazily built frames for Spark, common table expressions for the oracle."""

from __future__ import annotations

import datetime as dt
import itertools
import re
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.money import rs
from auditlens.operators import classify
from auditlens.operators.documents import REQUIREMENTS
from auditlens.operators.facts import with_facts
from auditlens.plans import audit as audit_plan
from auditlens.session import shared_dir
from auditlens.sources import rules as rule_files
from auditlens.sources import store as st
from auditlens.sources import testdata as td

TODAY = dt.date(2026, 1, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_SQL: dict[str, str] = {}


# Columns of findings that later steps of an audit read.
KEPT = ("tenant", "claim_id", "description", "head", "amount_paise", "service_date", "extract_confidence", "outside_stay", "outside_number", "classification",
        "bearer", "deducted_paise", "cited_chunk_id", "source", "severity")


class Context:
    """Frames of one (session, directory). Plans are built once and shared, data is never kept."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return td.table(self.spark, self.sf_dir, name)

    @cached_property
    def claims(self) -> DataFrame:
        return td.claims(self.spark, self.sf_dir)

    @cached_property
    def lines(self) -> DataFrame:
        return td.lines(self.spark, self.sf_dir)

    @cached_property
    def rules(self) -> DataFrame:
        return rule_files.catalogue(self.spark)[0]

    @cached_property
    def sources(self) -> DataFrame:
        return rule_files.catalogue(self.spark)[1]

    @cached_property
    def audit(self) -> audit_plan.Audit:
        return audit_plan.audit(self.claims, self.lines, self.rules, self.sources, today=TODAY)

    def kept_audit(self, *lines: str) -> audit_plan.Audit:
        """The audit with its findings and measures written to the shared folder first, for what reads them several times; each call works them out anew.

        Of the findings the columns are kept that measures and figures are made of, and those of `lines`."""
        def keep(name: str, rows: DataFrame) -> DataFrame:
            return staged(self, rows.select(*KEPT, *lines) if name == "findings" else rows, name)

        return audit_plan.audit(self.claims, self.lines, self.rules, self.sources, today=TODAY, keep=keep)

    def release(self, kept: audit_plan.Audit) -> None:
        """Delete the tables of a kept audit that nothing reads any more."""
        for table in (kept.findings, kept.facts):
            for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
                st.remove(self.spark, folder)

    def told(self) -> audit_plan.Audit:
        """The audit with a caller's narrative, over kept measures, which the narrative is made from as well."""
        kept = self.kept_audit()
        version = audit_plan.corpus_version(self.rules, self.sources, TODAY).select("corpus_version").scalar()
        return replace(kept, audits=audit_plan.audits_table(kept.facts, kept.findings, version, told=narrative(kept.facts)))

    @cached_property
    def store(self) -> st.Store:
        return st.store_rows(self.audit)

    @cached_property
    def vectors(self) -> tuple[DataFrame, DataFrame]:
        """Letter-count vectors of the texts and of the rules, standing in for embeddings."""
        texts = classify.other_texts(self.lines)
        body = classify.tx.search_text(F.col("title"), F.col("aliases"), F.col("body"))
        return (texts.select("text", td.letter_vector(F.col("text")).alias("vec")),
                self.rules.select("chunk_id", td.letter_vector(body).alias("vec")))

    def findings(self, strategy: str) -> DataFrame:
        if strategy not in self._findings:
            self._findings[strategy] = classify.classify_items(
                self.lines, self.rules, self.sources, strategy, vectors=self.vectors)
        return self._findings[strategy]

    @cached_property
    def _findings(self) -> dict[str, DataFrame]:
        return {}


def narrative(facts: DataFrame) -> DataFrame:
    """A caller's narrative of most claims; its figures are in the oracle's `quoted`."""
    text = F.concat(F.lit("Bill "), rs(F.col("gross_paise")), F.lit(", 12 days, claimed "), rs(F.col("gross_paise") + 12300),
                    F.lit(", room "), rs(F.col("room_days").cast("bigint") * 100000), F.lit("; room lines "), rs(F.col("room_billed")),
                    F.lit(" of a cover of "), rs(F.col("balance_paise")), F.lit("."))
    return facts.where("room_days % 4 <> 0").select("tenant", "claim_id", text.alias("narrative"))


def staged(x: Context, rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to a new folder in the shared folder and read again: computed, a table takes its whole plan every time it is read."""
    path = f"{shared_dir(x.spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return x.spark.read.parquet(path)


_NUMBERS = itertools.count()


def json_files(x: Context, rows: DataFrame, name: str) -> str:
    """Path of a folder in the shared folder with the texts `json` of `rows`, an array of those with one `part` a file."""
    path = f"{shared_dir(x.spark)}/{name}-{uuid.uuid4().hex}"
    arrays = rows.groupBy("part").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("json"), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def next_number() -> int:
    return next(_NUMBERS)


_CONTEXTS: dict[tuple[int, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (id(spark), sf_dir)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir)
    return _CONTEXTS[key]


def case(key: str, sql: str | None = None) -> Callable:
    """Register a query; `sql` may name any expression of `CTES`."""
    def add(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, sf_dir: fn(context(spark, sf_dir))
        if sql is not None:
            _SQL[key] = sql
        return fn
    return add


# --- oracle side -----------------------------------------------------------

CTES: dict[str, str] = {}


def with_ctes(sql: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"[a-z_0-9]+", text)) & CTES.keys() - needed:
            needed.add(name)
            visit(CTES[name])

    visit(sql)
    if not needed:
        return sql
    parts = [f"{name} AS {'MATERIALIZED ' if name == 'lines' else ''}({CTES[name]})" for name in CTES if name in needed]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


def expand() -> None:
    """Complete the oracle queries, once every module has added its expressions."""
    ORACLE.update({key: with_ctes(sql) for key, sql in _SQL.items() if key not in ORACLE})


def q(value: object) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _catalogue_values() -> str:
    """The packaged rules as VALUES, read with a few lines of Python of their own."""
    rows = []
    for f in sorted(resources.files("auditlens.catalog").iterdir(), key=lambda f: f.name):
        if not f.name.endswith(".md"):
            continue
        text = f.read_text(encoding="utf-8")
        file_meta = dict(re.findall(r"^(\w+): (.*)$", text.split("<!-- source:")[1].split("-->")[0], re.M))
        for pos, block in enumerate(text.split("<!-- chunk_id: ")[1:]):
            head, _, rest = block.partition("-->")
            chunk_id, *own = [p.strip() for p in head.split("|")]
            meta = {**file_meta, **dict(p.split(": ") for p in own)}
            lines = rest.strip().split("\n")
            title = lines[0].removeprefix("### ")
            alias_line = next((x for x in lines if x.startswith("Aliases: ")), None)
            aliases = [a.strip() for a in alias_line.removeprefix("Aliases: ").split(",")] if alias_line else []
            body = " ".join(x for x in lines[1:] if x != alias_line)
            rows.append("(" + ", ".join([q(f.name), str(pos), q(chunk_id), q(title), "[" + ", ".join(q(a) for a in aliases) + "]::VARCHAR[]", q(body)]
                        + [q(meta.get(k)) for k in ("jurisdiction", "severity", "source_id", "citation", "citation_precision", "list", "bearer", "topic")]) + ")")
    return ",\n".join(rows)


def _vocab_values() -> str:
    return ", ".join(f"({i}, {q(d)}, {q(h)})" for i, (d, h) in enumerate(td.VOCAB))


CTES["own"] = """
SELECT o_orderkey AS k, 'T' || (c_nationkey % 4) AS tenant, 'CLM-' || o_orderkey AS claim_id,
 CAST(o_orderdate AS DATE) AS admission_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS discharge_date,
 (2000 + 500 * (o_orderkey % 20)) * 100 AS rate, o_orderpriority AS diagnosis, CAST(round(o_totalprice * 100) AS BIGINT) AS price
FROM orders JOIN customer ON o_custkey = c_custkey"""

CTES["claims0"] = """
SELECT k, tenant, claim_id, CASE WHEN k % 3 = 0 THEN 'reimbursement' ELSE 'cashless' END AS claim_type, admission_date, discharge_date, diagnosis,
 CASE k % 4 WHEN 0 THEN 'Total knee replacement' WHEN 1 THEN 'Coronary artery bypass graft' WHEN 2 THEN 'Lens implant' END AS procedure,
 k % 7 = 0 AS is_accident, k % 10 = 3 AS involves_implant, k % 6 = 1 AS is_ped_related,
 CASE WHEN k % 5 <> 0 THEN (price * (4 + k % 5)) // 10 END AS preauth_paise,
 (3 + k % 8) * 10000000 AS sum_insured_paise, (3 + k % 8) * 10000000 - (k % 3) * 5000000 AS balance_paise,
 CASE WHEN k % 6 <> 5 THEN (4000 + 1000 * (k % 5)) * 100 END AS room_cap_paise,
 CASE WHEN k % 6 <> 5 THEN (4000 + 1000 * (k % 5)) * 200 END AS icu_cap_paise,
 CASE WHEN k % 6 IN (3, 4) THEN 10 WHEN k % 6 = 5 THEN 20 ELSE 0 END AS copay_pct,
 CASE WHEN k % 8 = 0 THEN 500000 ELSE 0 END AS deductible_paise, rate AS rate_paise,
 greatest(k % 9, 1) + CASE WHEN k % 13 = 0 THEN 2 ELSE 0 END AS room_days, k % 11 = 0 AS is_icu,
 strftime(discharge_date, '%Y-%m') AS month
FROM own"""

CTES["vocab"] = f"SELECT * FROM (VALUES {_vocab_values()}) AS v(vocab_id, description, head)"

CTES["lines1"] = """
SELECT o.k, o.tenant, o.claim_id, (CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) * 1000 + l_suppkey % 1000 AS line_no, l_linenumber,
 v.description, v.head, CASE WHEN v.head = 'ROOM' THEN 1 + l_linenumber % 3 ELSE 1 END AS quantity,
 CASE WHEN v.head = 'ROOM' AND l_partkey % 3 <> 0 THEN o.rate ELSE 0 END AS unit_rate_paise, l_partkey,
 CASE WHEN v.head = 'ROOM' THEN o.rate * (1 + l_linenumber % 3)
      WHEN v.head = 'OTHER' THEN CAST(round(l_extendedprice * 100) AS BIGINT) // 25
      ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS base,
 CASE WHEN l_partkey % 5 <> 0 THEN o.admission_date + CAST((l_partkey + l_linenumber) % 12 AS INTEGER) END AS service_date,
 CASE WHEN l_discount < 0.01 THEN 0.5 ELSE 0.95 END AS extract_confidence, o.admission_date, o.discharge_date
FROM lineitem JOIN own o ON l_orderkey = o.k JOIN vocab v ON v.vocab_id = l_partkey % 40"""

CTES["lines2"] = """
SELECT * FROM lines1 UNION ALL
SELECT k, tenant, claim_id, line_no + 100000000000000, * EXCLUDE (k, tenant, claim_id, line_no) FROM lines1 WHERE k % 17 = 0 AND l_linenumber = 1"""

CTES["lines"] = """
SELECT k, tenant, claim_id, line_no, description, head, quantity, unit_rate_paise,
 CASE WHEN l_partkey % 97 = 0 THEN -base WHEN k % 29 = 0 THEN (base // 100000) * 100000 ELSE base END AS amount_paise,
 service_date, extract_confidence,
 COALESCE(service_date NOT BETWEEN admission_date AND discharge_date, FALSE) AS outside_stay
FROM lines2"""

CTES["rules"] = f"""SELECT * FROM (VALUES {_catalogue_values()})
 AS r(path, pos, chunk_id, title, aliases, body, jurisdiction, severity, source_id, citation, citation_precision, list_name, bearer, topic)"""

CTES["rule_sources"] = """SELECT * FROM (VALUES
 ('CAT-LISTS', 'House catalogue of non-payable items', 'HC/1', 'unverified', NULL, NULL::DATE),
 ('CAT-WORDING', 'Sample policy wording', '', 'in_force', NULL, DATE '2024-02-01'),
 ('CAT-UNUSED', 'A source no rule cites', '', 'superseded', 'CAT-LISTS', NULL::DATE)
) AS s(source_id, source_title, reference, status, superseded_by, verified_on)"""

CTES["aliases"] = """
SELECT path, pos, chunk_id, list_name, title, i AS alias_pos, lower(trim(aliases[i])) AS alias
FROM rules, range(1, 20) AS t(i) WHERE list_name IS NOT NULL AND i <= len(aliases)"""

CTES["texts"] = "SELECT DISTINCT lower(description) AS text FROM lines WHERE head = 'OTHER'"

CTES["alias_hits"] = r"""
SELECT text, a.* FROM texts, aliases a
WHERE CASE WHEN contains(alias, ' ') OR contains(alias, '-') THEN contains(text, alias)
 ELSE regexp_matches(text, '\b' || regexp_escape(alias) || 's?\b') END"""

CTES["best_alias"] = """
SELECT text, chunk_id, list_name, title, alias FROM alias_hits
QUALIFY row_number() OVER (PARTITION BY text ORDER BY length(alias) DESC, path, pos, alias_pos) = 1"""

CTES["verdicts"] = """
SELECT t.text, COALESCE(list_name, 'UNMAPPED') AS classification, chunk_id,
 CASE WHEN chunk_id IS NULL THEN 'retrieval' ELSE 'keyword' END AS source
FROM texts t LEFT JOIN best_alias b ON b.text = t.text"""

CTES["rule_facts"] = """
SELECT r.chunk_id, r.bearer AS rule_bearer, r.severity AS rule_severity, r.title AS rule_title, r.source_id,
 COALESCE(NULLIF(s.reference, ''), s.source_title, r.source_id) || ', ' || r.citation AS citation
FROM rules r LEFT JOIN rule_sources s ON s.source_id = r.source_id"""


def findings_sql(verdict_cte: str, primary_source: str) -> str:
    """Findings over a verdict table (text, classification, chunk_id, source)."""
    return f"""
SELECT l.*, v.chunk_id AS cited_chunk_id, COALESCE(v.classification, 'PAYABLE') AS classification,
 CASE WHEN l.head = 'OTHER' THEN v.source ELSE '{primary_source}' END AS source,
 COALESCE(r.rule_bearer, CASE COALESCE(v.classification, 'PAYABLE') WHEN 'PAYABLE' THEN 'INSURER' WHEN 'LIST_I_OPTIONAL' THEN 'PATIENT'
   WHEN 'UNMAPPED' THEN 'UNKNOWN' ELSE 'HOSPITAL' END) AS bearer,
 COALESCE(r.rule_severity, CASE COALESCE(v.classification, 'PAYABLE') WHEN 'PAYABLE' THEN 'INFO' WHEN 'LIST_I_OPTIONAL' THEN 'INFO'
   WHEN 'UNMAPPED' THEN 'BLOCKER' ELSE 'WARNING' END) AS severity,
 CASE WHEN v.classification LIKE 'LIST_%' THEN l.amount_paise ELSE 0 END AS deducted_paise,
 CASE WHEN v.classification LIKE 'LIST_%' THEN l.amount_paise END AS impact_paise,
 COALESCE(r.citation, '') AS citation, COALESCE(r.source_id, '') AS source_id, r.rule_title
FROM lines l LEFT JOIN {verdict_cte} v ON l.head = 'OTHER' AND v.text = lower(l.description)
LEFT JOIN rule_facts r ON r.chunk_id = v.chunk_id"""


CTES["findings"] = findings_sql("verdicts", "retrieval")


def facts_sql(claims: str, findings: str) -> str:
    heads = ("ROOM", "NURSING", "PROCEDURE", "CONSULTATION", "INVESTIGATION", "PHARMACY", "IMPLANT", "OTHER")
    payable = ", ".join(f"COALESCE(sum(amount_paise - deducted_paise) FILTER (head = '{h}'), 0) AS payable_{h.lower()}" for h in heads)
    return f"""
SELECT c.*, COALESCE(f.n_lines, 0) AS n_lines, COALESCE(f.gross_paise, 0) AS gross_paise,
 COLUMNS(f.* EXCLUDE (tenant, claim_id, n_lines, gross_paise)),
 COALESCE(d.n_repeated, 0) AS n_repeated, COALESCE(d.repeated_paise, 0) AS repeated_paise
FROM {claims} c LEFT JOIN (
 SELECT tenant, claim_id, count(*) AS n_lines, sum(amount_paise) AS gross_paise,
 COALESCE(sum(deducted_paise) FILTER (bearer = 'PATIENT'), 0) AS patient_items,
 COALESCE(sum(deducted_paise) FILTER (bearer = 'HOSPITAL'), 0) AS hospital_items, {payable},
 count(*) FILTER (head = 'IMPLANT') AS lines_implant, count(*) FILTER (head = 'INVESTIGATION') AS lines_investigation,
 count(*) FILTER (head = 'PROCEDURE') AS lines_procedure, count(*) FILTER (head = 'PHARMACY') AS lines_pharmacy,
 COALESCE(sum(amount_paise) FILTER (head = 'ROOM'), 0) AS room_billed,
 count(*) FILTER (outside_stay) AS n_outside, COALESCE(sum(amount_paise) FILTER (outside_stay), 0) AS outside_paise,
 count(*) FILTER (contains(lower(description), 'icu')) AS n_icu_named,
 COALESCE(sum(amount_paise) FILTER (classification = 'UNMAPPED'), 0) AS unmapped_paise, count(*) FILTER (classification = 'UNMAPPED') AS n_unmapped,
 COALESCE(sum(amount_paise) FILTER (extract_confidence < 0.7 AND classification <> 'UNMAPPED'), 0) AS unsure_paise,
 count(*) FILTER (extract_confidence < 0.7 AND classification <> 'UNMAPPED') AS n_unsure,
 count(*) FILTER (amount_paise >= 100000) AS n_big, count(*) FILTER (amount_paise >= 100000 AND amount_paise % 100000 = 0) AS n_round,
 count(*) FILTER (classification <> 'PAYABLE') AS n_items
 FROM {findings} GROUP BY tenant, claim_id) f ON f.tenant = c.tenant AND f.claim_id = c.claim_id
LEFT JOIN (SELECT tenant, claim_id, count(*) AS n_repeated, sum(amount_paise * (n - 1)) AS repeated_paise FROM (
 SELECT tenant, claim_id, amount_paise, count(*) AS n FROM {findings}
 GROUP BY tenant, claim_id, lower(trim(description)), amount_paise, service_date HAVING count(*) > 1) GROUP BY tenant, claim_id) d
 ON d.tenant = c.tenant AND d.claim_id = c.claim_id"""


CTES["facts0"] = facts_sql("claims0", "findings")
_NUMERIC = ("patient_items hospital_items payable_room payable_nursing payable_procedure payable_consultation payable_investigation payable_pharmacy "
            "payable_implant payable_other lines_implant lines_investigation lines_procedure lines_pharmacy room_billed n_outside outside_paise "
            "n_icu_named unmapped_paise n_unmapped unsure_paise n_unsure n_big n_round n_items").split()
_ZEROED = "SELECT * REPLACE (" + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in _NUMERIC) + ") FROM "
CTES["facts"] = _ZEROED + "facts0"

CTES["profiles"] = """SELECT * FROM (VALUES ('conservative', ['PHARMACY', 'IMPLANT']), ('typical', ['PHARMACY', 'IMPLANT', 'INVESTIGATION']),
 ('lenient', ['PHARMACY', 'IMPLANT', 'INVESTIGATION', 'CONSULTATION'])) AS p(profile, excluded)"""


def waterfall_ctes(prefix: str, facts: str) -> None:
    """Six dependent steps, each on the balance the one before has left."""
    p = prefix
    CTES[f"{p}0"] = f"""
SELECT f.*, p.profile, CASE WHEN is_icu THEN icu_cap_paise ELSE room_cap_paise END AS cap, gross_paise - patient_items - hospital_items AS b0,
 payable_nursing + payable_procedure + payable_other
 + CASE WHEN list_contains(excluded, 'CONSULTATION') THEN 0 ELSE payable_consultation END
 + CASE WHEN list_contains(excluded, 'INVESTIGATION') THEN 0 ELSE payable_investigation END AS assoc
FROM {facts} f CROSS JOIN profiles p"""
    CTES[f"{p}1"] = f"""SELECT *, CASE WHEN cap > 0 AND rate_paise > cap THEN greatest(least((rate_paise - cap) * room_days, payable_room), 0) ELSE 0 END AS w1 FROM {p}0"""
    CTES[f"{p}2"] = f"""SELECT *, greatest(least(w1, b0), 0) AS s1, b0 - greatest(least(w1, b0), 0) AS b1,
 CASE WHEN cap > 0 AND rate_paise > cap THEN (2 * greatest(assoc, 0)::HUGEINT * (rate_paise - cap) + rate_paise) // (2 * rate_paise) ELSE 0 END AS w2 FROM {p}1"""
    CTES[f"{p}3"] = f"""SELECT *, greatest(least(w2, b1), 0)::BIGINT AS s2, (b1 - greatest(least(w2, b1), 0))::BIGINT AS b2 FROM {p}2"""
    CTES[f"{p}4"] = f"""SELECT *, CASE WHEN k % 4 = 0 AND b2 > 12000000 THEN b2 - 12000000 WHEN k % 4 = 1 AND b2 > 15000000 THEN b2 - 15000000
 WHEN k % 4 = 1 AND b2 > 9000000 THEN b2 - 9000000 ELSE 0 END AS s3 FROM {p}3"""
    CTES[f"{p}5"] = f"""SELECT *, b2 - s3 AS b3, greatest(least(deductible_paise, b2 - s3), 0) AS s4 FROM {p}4"""
    CTES[f"{p}6"] = f"""SELECT *, b3 - s4 AS b4, CASE WHEN b3 - s4 > 0 THEN (2 * (b3 - s4) * copay_pct * 100 + 10000) // 20000 ELSE 0 END AS s5 FROM {p}5"""
    CTES[f"{p}7"] = f"""SELECT *, b4 - s5 AS b5, greatest(b4 - s5 - balance_paise, 0) AS s6 FROM {p}6"""
    CTES[p] = f"""SELECT *, b5 - s6 AS settlement_paise, patient_items + s1 + s2 + s3 + s4 + s5 + s6 AS patient_paise, hospital_items AS hospital_paise,
 s1 + s2 AS room_rent_paise FROM {p}7"""


waterfall_ctes("wf", "facts")

_DOCS = ", ".join(f"({i}, {q(d)}, {q(n)}, {q(s)})" for i, (d, n, s) in enumerate(REQUIREMENTS))
CTES["requirements"] = f"SELECT * FROM (VALUES {_DOCS}) AS q(n, document_id, name, severity)"

CTES["gaps"] = """
SELECT f.tenant, f.claim_id, q.document_id, q.name, q.severity, q.n FROM facts f CROSS JOIN requirements q
WHERE (f.k * 7 + 13 * q.n) % 10 >= 7 AND CASE q.document_id
 WHEN 'DOC-MLC' THEN is_accident WHEN 'DOC-IMPLANT-INV' THEN involves_implant OR lines_implant > 0 WHEN 'DOC-PED-HISTORY' THEN is_ped_related
 WHEN 'DOC-INDOOR-PAPERS' THEN gross_paise > 10000000 OR claim_type = 'reimbursement'
 WHEN 'DOC-INVESTIGATION-REPORTS' THEN lines_investigation > 0 WHEN 'DOC-OT-NOTES' THEN lines_procedure > 0
 WHEN 'DOC-PHARMACY-BILLS' THEN lines_pharmacy > 0
 WHEN 'DOC-PREAUTH-ENHANCEMENT' THEN COALESCE(preauth_paise <> 0 AND gross_paise * 10 > preauth_paise * 11, FALSE) ELSE TRUE END"""

CTES["checks_wide"] = """
SELECT *, CAST(discharge_date - admission_date AS BIGINT) AS los, abs(room_billed - rate_paise * room_days) AS room_gap FROM facts"""
_CHECK = """SELECT tenant, claim_id, {n} AS reg, '{id}' AS check_id, '{sev}' AS severity, CAST({impact} AS BIGINT) AS impact_paise FROM checks_wide WHERE {cond}"""
CHECK_SQL = (
    ("CHK-LOS-ROOM", "BLOCKER", "rate_paise * (room_days - los)", "room_days > los"),
    ("CHK-ROOM-TOTAL", "WARNING", "room_gap", "room_billed <> 0 AND room_gap > 100"),
    ("CHK-DATE-WINDOW", "WARNING", "outside_paise", "n_outside > 0"),
    ("CHK-PREAUTH-VARIANCE", "BLOCKER", "gross_paise - preauth_paise", "preauth_paise > 0 AND gross_paise * 10 > preauth_paise * 11"),
    ("CHK-DUPLICATE-LINE", "WARNING", "repeated_paise", "n_repeated > 0"),
    ("CHK-ICU-NO-CHARGE", "INFO", "NULL", "is_icu AND n_icu_named = 0"),
    ("CHK-UNMAPPED-SHARE", "WARNING", "unmapped_paise", "gross_paise > 0 AND unmapped_paise * 10 > gross_paise"),
    ("CHK-ROUND-NUMBER", "INFO", "NULL", "n_big >= 8 AND n_round * 10 > n_big * 7"),
    ("CHK-DAYCARE-LOS", "INFO", "NULL", "los = 0 AND room_days > 0"),
)
CTES["flags"] = " UNION ALL ".join(_CHECK.format(n=n, id=i, sev=s, impact=m, cond=c) for n, (i, s, m, c) in enumerate(CHECK_SQL))

SEV = "CASE severity WHEN 'BLOCKER' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END"

CTES["credit_claims"] = "SELECT DISTINCT tenant, claim_id FROM lines WHERE amount_paise < 0"


def half_even(num: str, den: str) -> str:
    """Exact half-even division in integers, any sign of num, den > 0."""
    n, d = f"({num})::HUGEINT", f"({den})::HUGEINT"
    r = f"((({n} % {d}) + {d}) % {d})"
    fl = f"(({n} - {r}) // {d})"
    return f"({fl} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {fl} % 2 <> 0) THEN 1 ELSE 0 END)"


def decimal_text(units: str, scale: int) -> str:
    """Integer units as text with `scale` decimals, as a DECIMAL prints."""
    p = 10 ** scale
    return (f"(CASE WHEN {units} < 0 THEN '-' ELSE '' END || CAST(abs({units}) // {p} AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({units}) % {p} AS VARCHAR), {scale}, '0'))")
