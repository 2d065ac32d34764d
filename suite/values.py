"""Cases for the scalar functions, over the columns of the warehouse."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from auditlens.functions import hashing as hs
from auditlens.functions import money as m
from auditlens.functions import text as tx
from auditlens.functions import vocabulary as voc
from auditlens.operators import ledger
from suite import base as b
from suite.base import CTES, case

K = ["tenant", "claim_id"]


def orders(x):
    return x.table("orders").withColumn("k", F.col("o_orderkey"))


@case("FN1", f"SELECT o_orderkey AS k, {b.decimal_text('((o_orderkey * 125 + 50) // 100)', 2)} AS value FROM orders")
def fn1(x):
    return orders(x).select("k", m.quantize(F.col("k").cast("decimal(18,0)") * F.lit(Decimal("0.0125"))).cast("decimal(18,2)").cast("string").alias("value"))


@case("FN2", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS paise FROM orders")
def fn2(x):
    price = F.when(F.col("k") % 7 != 0, m.as_decimal(F.col("o_totalprice"), 2))
    return orders(x).select("k", m.to_paise(price).alias("paise"))


@case("FN3", f"SELECT k, {b.decimal_text('p', 2)} AS rupees FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS p FROM orders)")
def fn3(x):
    paise = F.when(F.col("k") % 7 != 0, F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return orders(x).select("k", m.from_paise(paise).cast("string").alias("rupees"))


_GROUP = r"CASE WHEN length({d}) > 3 THEN ltrim(reverse(regexp_replace(reverse(left({d}, length({d}) - 3)), '(\d\d)', '\1,', 'g')), ',') || ',' || right({d}, 3) ELSE {d} END"


@case("FN4", f"""SELECT k, CASE WHEN p IS NULL THEN '—' ELSE CASE WHEN r < 0 THEN '-' ELSE '' END || '₹' || {_GROUP.format(d='CAST(abs(r) AS VARCHAR)')} END AS whole,
 CASE WHEN p IS NULL THEN '—' ELSE CASE WHEN p < 0 THEN '-' ELSE '' END || '₹' || {_GROUP.format(d='CAST(abs(p) // 100 AS VARCHAR)')} || '.' || lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0') END AS exact
 FROM (SELECT *, CASE WHEN p < 0 THEN -1 ELSE 1 END * ((abs(p) + 50) // 100) AS r FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL
 WHEN o_orderkey % 2 = 0 THEN -CAST(round(o_totalprice * 100) AS BIGINT) * 37 ELSE CAST(round(o_totalprice * 100) AS BIGINT) // (1 + o_orderkey % 1000) END AS p FROM orders))""")
def fn4(x):
    p = F.round(F.col("o_totalprice") * 100).cast("bigint")
    paise = F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 2 == 0, -p * 37).otherwise(F.call_function("div", p, F.lit(1) + F.col("k") % 1000))
    value = F.when(paise.isNotNull(), m.from_paise(paise))
    return orders(x).select("k", m.rupees(value).alias("whole"), m.rupees(value, paise=True).alias("exact"))


@case("FN5", """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN u * 100 + 50 WHEN 1 THEN u * 100 WHEN 2 THEN 700 WHEN 3 THEN 700 ELSE -u * 100 END AS paise
 FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS u FROM orders)""")
def fn5(x):
    u = F.round("o_totalprice").cast("bigint")
    text = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit(" Rs "), F.format_number(u, 0), F.lit(".50\t")))
        .when(F.col("k") % 5 == 1, F.concat(F.lit("₹"), u.cast("string"))).when(F.col("k") % 5 == 2, "  ")
        .when(F.col("k") % 5 == 3, "see note").otherwise(F.concat(F.lit("-"), F.format_number(u, 0))))
    return orders(x).select("k", (m.parse_amount(text, "7") * 100).cast("bigint").alias("paise"))


@case("FN6", "SELECT o_orderkey AS k, CAST(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,6)) AS VARCHAR) AS value FROM orders")
def fn6(x):
    return orders(x).select("k", m.as_decimal(F.col("o_totalprice"), 6).cast("string").alias("value"))


@case("FN7", "SELECT tenant, claim_id, CAST(discharge_date - admission_date AS INTEGER) AS los FROM claims0")
def fn7(x):
    return x.claims.select(*K, tx.length_of_stay(F.col("admission_date"), F.col("discharge_date")).alias("los"))


@case("FN8", "SELECT tenant, claim_id, strftime(discharge_date, '%Y-%m') AS by_discharge, strftime(admission_date, '%Y-%m') AS by_admission FROM claims0")
def fn8(x):
    a, d = F.col("admission_date"), F.col("discharge_date")
    return x.claims.select(*K, tx.claim_month(a, d).alias("by_discharge"), tx.claim_month(a, d, "admission").alias("by_admission"))


@case("FN9", "SELECT lower(trim(description)) AS item, count(*) AS n FROM lines GROUP BY 1")
def fn9(x):
    return x.lines.groupBy(tx.item_key(F.col("description")).alias("item")).agg(F.count(F.lit(1)).alias("n"))


@case("FN10", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def fn10(x):
    return x.table("documents").select("doc_id", F.md5(tx.normalise_text(F.col("text")).cast("binary")).alias("digest"))


@case("FN11", "SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def fn11(x):
    t = tx.tokenize(F.col("text"))
    return x.table("documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


_DEPTS = ("Accommodation", "NURSING care", "Surgical unit", "Minor procedures", "Professional fees", "Consultation", "Diagnostics", "Radiology",
          "Lab services", "Pharmacy store", "Implants", "Canteen", "Surgical pharmacy", "Collaboration")
_HEADS = ("ROOM", "NURSING", "PROCEDURE", "PROCEDURE", "CONSULTATION", "CONSULTATION", "INVESTIGATION", "INVESTIGATION",
          "INVESTIGATION", "PHARMACY", "IMPLANT", "OTHER", "PROCEDURE", "INVESTIGATION")


@case("FN12", f"SELECT l_partkey % 14 AS d, {list(_HEADS)}[l_partkey % 14 + 1] AS head, count(*) AS n FROM lineitem GROUP BY ALL")
def fn12(x):
    dept = F.element_at(F.array(*[F.lit(d) for d in _DEPTS]), (F.col("l_partkey") % 14 + 1).cast("int"))
    return x.table("lineitem").groupBy((F.col("l_partkey") % 14).alias("d"), tx.head_from_department(dept).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@case("FN13", "SELECT description, contains(lower(description), 'icu') AS icu, count(*) AS n FROM lines GROUP BY ALL")
def fn13(x):
    return x.lines.groupBy("description", tx.is_icu(F.col("description")).alias("icu")).agg(F.count(F.lit(1)).alias("n"))


@case("FN14", """SELECT tenant, claim_id, line_no, CAST(CASE WHEN unit_rate_paise > 0 THEN unit_rate_paise
 ELSE round(CAST(amount_paise AS DOUBLE) / quantity) END AS BIGINT) AS rate FROM lines""")
def fn14(x):
    rate = m.rate_per_day(F.col("unit_rate_paise"), F.col("quantity"), F.col("amount_paise"))
    return x.lines.select(*K, "line_no", F.round(rate, 0).cast("bigint").alias("rate"))


_LANES = ", ".join(f"sum(CAST('0x' || substr(h, {i * 15 + 1}, 15) AS BIGINT)) AS s{i}" for i in range(4))


@case("FN15", f"""SELECT c.tenant, c.claim_id, sha256('{{"claim_id":"' || c.claim_id || '","claim_type":"' || claim_type || '","room_days":' || room_days || ',"tenant":"' || c.tenant || '"}}'
 || '#' || concat_ws('|', COALESCE(n, 0), COALESCE(s0, 0), COALESCE(s1, 0), COALESCE(s2, 0), COALESCE(s3, 0))) AS packet_digest
 FROM claims0 c LEFT JOIN (SELECT tenant, claim_id, count(*) AS n, {_LANES} FROM (
 SELECT tenant, claim_id, sha256(amount_paise || '|' || description || '|' || line_no) AS h FROM lines) GROUP BY tenant, claim_id) l
 ON l.tenant = c.tenant AND l.claim_id = c.claim_id""")
def fn15(x):
    return ledger.packet_digest(x.claims.select(*K, "claim_type", "room_days"), x.lines.select(*K, "line_no", "description", "amount_paise"))


@case("FN16", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS fingerprint FROM events""")
def fn16(x):
    return x.table("events").select("event_id", hs.request_fingerprint(user_id=F.col("user_id"), event_type=F.col("event_type")).alias("fingerprint"))


_SALT = "pepper"


def _blob(mask: int) -> str:
    key = _SALT.encode().ljust(64, b"\0")
    return "'" + "".join(f"\\x{c ^ mask:02X}" for c in key) + "'::BLOB"


@case("FN17", f"SELECT claim_id, left(sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || encode(claim_id)))), 24) AS alias FROM claims0")
def fn17(x):
    return x.claims.select("claim_id", hs.pseudonymise(F.col("claim_id"), _SALT).alias("alias"))


@case("FN18", "SELECT classification, CASE classification WHEN 'PAYABLE' THEN 'INSURER' WHEN 'LIST_I_OPTIONAL' THEN 'PATIENT' WHEN 'UNMAPPED' THEN 'UNKNOWN' ELSE 'HOSPITAL' END AS bearer, count(*) AS n FROM findings GROUP BY ALL")
def fn18(x):
    return x.audit.findings.groupBy("classification", voc.bearer_of(F.col("classification")).alias("bearer")).agg(F.count(F.lit(1)).alias("n"))


@case("FN19", f"SELECT severity, {b.SEV} AS rank, count(*) AS n FROM findings GROUP BY ALL")
def fn19(x):
    return x.audit.findings.groupBy("severity", voc.severity_rank(F.col("severity")).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


CTES["counts_json"] = """
SELECT c.tenant, c.claim_id, '{' || COALESCE(string_agg('"' || classification || '":' || n, ',' ORDER BY CASE classification WHEN 'LIST_III_PROCEDURE' THEN 1
 WHEN 'LIST_II_ROOM' THEN 2 WHEN 'LIST_IV_TREATMENT' THEN 3 WHEN 'LIST_I_OPTIONAL' THEN 4 WHEN 'PAYABLE' THEN 5 ELSE 6 END), '') || '}' AS finding_counts
FROM claims0 c LEFT JOIN (SELECT tenant, claim_id, classification, count(*) AS n FROM findings GROUP BY ALL) f ON f.tenant = c.tenant AND f.claim_id = c.claim_id
GROUP BY c.tenant, c.claim_id"""


@case("FN20", "SELECT * FROM counts_json")
def fn20(x):
    return x.audit.audits.select(*K, ledger.finding_counts_json(F.col("class_counts")).alias("finding_counts"))


@case("FN21", r"SELECT doc_id, len(r) AS n, replace(array_to_string(r, ' '), ',', '') AS figures FROM (SELECT doc_id, regexp_extract_all(text, '(?:Rs\.?\s*|₹\s*)?(\d[\d,]{3,}(?:\.\d{1,2})?)', 1) AS r FROM documents)")
def fn21(x):
    r = tx.money_mentions(F.col("text"))
    return x.table("documents").select("doc_id", F.size(r).cast("bigint").alias("n"), F.replace(F.array_join(r, " "), F.lit(","), F.lit("")).alias("figures"))


@case("FN25", """SELECT doc_id, len(pieces) AS n, array_to_string(list_transform(pieces, lambda p: CAST(length(p) AS VARCHAR)), ',') AS sizes FROM (
 SELECT doc_id, list_filter(string_split(CASE WHEN length(text) <= 1500 THEN text ELSE list_reduce(
  list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i < len(string_split(text, chr(10))) THEN l || chr(10) ELSE l END),
  lambda acc, l: CASE WHEN l = '' THEN acc WHEN length(string_split(acc, chr(1))[-1]) + length(l) > 1500 THEN acc || chr(1) || l ELSE acc || l END) END, chr(1)),
  lambda p: length(text) <= 1500 OR trim(p, chr(10) || ' ' || chr(9) || chr(13)) <> '') AS pieces FROM documents)""")
def fn25(x):
    p = tx.chunk_text(F.col("text"), 1500)
    return x.table("documents").select("doc_id", p.alias("p")).select(
        "doc_id", F.size("p").cast("bigint").alias("n"), F.array_join(F.transform("p", lambda t: F.length(t).cast("string")), ",").alias("sizes"))
