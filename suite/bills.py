"""Cases for bill rows, document types and extraction scores, over table cells written from `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.operators import documents, evaluate, extraction
from auditlens.sources import records
from suite import base as b
from suite.base import CTES, case

_DEPTS = ("Accommodation", "Nursing care", "Surgical", "Professional fees", "Radiology lab", "Pharmacy store", "Implants", "Misc")
_DHEADS = ("ROOM", "NURSING", "PROCEDURE", "CONSULTATION", "INVESTIGATION", "PHARMACY", "IMPLANT", "OTHER")


def cells(x) -> DataFrame:
    p = F.col("l_partkey")
    s = lambda c: c.cast("string")
    units = F.col("l_extendedprice").cast("bigint")
    amount = (
        F.when(p % 19 == 0, "0").when(p % 23 == 0, "n/a")
        .otherwise(F.concat(F.lit("₹ "), s(F.call_function("div", units, F.lit(1000))), F.lit(","), F.lpad(s(units % 1000), 3, "0"), F.lit(".50"))))
    row = F.array(
        F.when(p % 13 == 0, "Sr").otherwise(s(p % 100 + 1)),
        F.when(p % 17 == 0, " ").otherwise(F.concat(F.lit(" Item "), s(p % 50), F.when(p % 8 == 0, " ICU").otherwise(""))),
        F.element_at(F.array(*[F.lit(d) for d in _DEPTS]), (p % 8 + 1).cast("int")),
        F.when(p % 7 == 0, "").otherwise(s(p % 4 + 1)), F.when(p % 5 == 0, "").otherwise(F.concat(F.lit("Rs "), s(p % 900 + 100))), amount)
    return x.table("lineitem").select(
        F.concat(F.lit("BILL-"), s(F.col("l_orderkey"))).alias("doc_id"), F.col("l_linenumber").alias("page"),
        (p * 100000 + F.col("l_suppkey") % 1000 * 100 + F.col("l_quantity").cast("bigint")).alias("row_no"),
        F.when(p % 29 == 0, F.slice(row, 1, 5)).otherwise(row).alias("cells"))


CTES["raw_rows"] = f"""
SELECT 'BILL-' || l_orderkey AS doc_id, l_linenumber AS page, l_partkey * 100000 + l_suppkey % 1000 * 100 + CAST(l_quantity AS BIGINT) AS row_no, l_partkey AS p,
 'Item ' || l_partkey % 50 || CASE WHEN l_partkey % 8 = 0 THEN ' ICU' ELSE '' END AS description, {list(_DHEADS)}[l_partkey % 8 + 1] AS head,
 CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE l_partkey % 4 + 1 END AS quantity, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_partkey % 900 + 100 END AS unit_rate,
 CAST(trunc(l_extendedprice) AS BIGINT) * 100 + 50 AS paise FROM lineitem
WHERE l_partkey % 29 <> 0 AND l_partkey % 13 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AND l_partkey % 23 <> 0"""
CTES["bill_items"] = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, row_no) AS line_no FROM raw_rows"
CTES["bill_unique"] = """
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, row_no) AS n FROM (
 SELECT * FROM bill_items QUALIFY row_number() OVER (PARTITION BY doc_id, lower(description), paise ORDER BY page, row_no) = 1)"""


def items(x) -> DataFrame:
    return extraction.rows_to_items(cells(x))


@case("X1", "SELECT doc_id, line_no, description, head, CAST(quantity AS BIGINT) AS quantity, CAST(unit_rate AS BIGINT) AS unit_rate, paise FROM bill_items")
def x1(x):
    return items(x).select("doc_id", "line_no", "description", "head", F.col("quantity").cast("bigint").alias("quantity"),
                           F.col("unit_rate").cast("bigint").alias("unit_rate"), (F.col("amount") * 100).cast("bigint").alias("paise"))


@case("X2", "SELECT doc_id, n AS line_no, description, paise FROM bill_unique")
def x2(x):
    # A bill that was read twice: every row comes again on a later page.
    twice = items(x)
    again = twice.withColumn("page", F.col("page") + 100)
    return extraction.dedupe_rows(twice.unionByName(again), drop_blank=True).select("doc_id", "line_no", "description", (F.col("amount") * 100).cast("bigint").alias("paise"))


CTES["bill_stays"] = """
SELECT doc_id, CAST(sum(quantity) AS BIGINT) AS days, arg_min(description, line_no) FILTER (top) AS room_category, CAST(round(max(rate)) AS BIGINT) AS rate
FROM (SELECT *, rate = max(rate) OVER (PARTITION BY doc_id) AS top FROM (
 SELECT *, CASE WHEN unit_rate > 0 THEN CAST(unit_rate * 100 AS DOUBLE) ELSE round(CAST(paise AS DOUBLE) / quantity, 6) END AS rate FROM bill_items WHERE head = 'ROOM')) GROUP BY doc_id"""


@case("X3", "SELECT doc_id, days, room_category, rate, contains(room_category, 'ICU') AS is_icu FROM bill_stays WHERE days >= 1 AND rate > 0")
def x3(x):
    return extraction.room_stay_from_items(items(x)).select("doc_id", "days", "room_category", F.round("rate_paise", 0).cast("bigint").alias("rate"), "is_icu")


@case("X4", "SELECT doc_id, count(*) AS n_items FROM bill_items GROUP BY doc_id HAVING count(*) >= 3")
def x4(x):
    return extraction.accepted_documents(items(x))


@case("X5", "SELECT doc_id, count(*) AS n_items, bool_or(head = 'IMPLANT') AS has_implant, count(*) FILTER (p % 9 = 0) AS low_confidence, 'text_layer' AS method FROM bill_items GROUP BY doc_id")
def x5(x):
    seen = items(x).withColumn("extract_confidence", F.when(F.call_function("div", F.col("row_no"), F.lit(100000)) % 9 == 0, 0.4).otherwise(1.0))
    return extraction.extraction_summary(seen)


# --- document types ----------------------------------------------------------------------

# Headings put in front of every page's text; the text itself stays whole.
_HEADINGS = ("Discharge  Summary\nFinal Diagnosis", "CLAIM FORM declaration", "Pharmacy bill\nsum insured waiting period", "Laboratory report, reference\trange",
             "itemised bill implant", "Aadhaar PAN card", "", "deduction summary net payable reason for deduction", "ot notes nursing notes")


def page_texts(x) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADINGS]), (F.col("page_id") % len(_HEADINGS) + 1).cast("int"))
    return x.table("pages").select(F.col("page_id").alias("doc_id"), F.concat(head, F.lit("\n"), "html").alias("text"))


_SIGS = ", ".join("(%d, %s, %s, [%s])" % (i, b.q(d), b.q(label), ", ".join(b.q(w) for w in words)) for i, (d, label, words) in enumerate(documents.SIGNATURES))
_HEADS_SQL = "[" + ", ".join("'" + h.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for h in _HEADINGS) + "]"
CTES["signatures"] = f"SELECT * FROM (VALUES {_SIGS}) AS s(ord, document_type, document_label, words)"
CTES["page_text"] = f"SELECT page_id AS doc_id, trim(regexp_replace(lower({_HEADS_SQL}[page_id % {len(_HEADINGS)} + 1] || chr(10) || html), '\\s+', ' ', 'g')) AS text FROM pages"
CTES["detected"] = """
SELECT h.doc_id, arg_max(h.document_type, h.hits * 100 - h.ord) AS best_type, arg_max(h.document_label, h.hits * 100 - h.ord) AS best_label, max(h.hits) AS hits FROM (
 SELECT p.doc_id, s.ord, s.document_type, s.document_label, len(list_filter(s.words, lambda w: contains(p.text, w))) AS hits FROM page_text p, signatures s) h
GROUP BY h.doc_id"""


@case("D14", "SELECT doc_id, CASE WHEN hits > 0 THEN best_type END AS document_type, CASE WHEN hits > 0 THEN best_label ELSE 'Unrecognised' END AS document_label, CAST(hits AS INTEGER) AS keyword_hits FROM detected")
def d14(x):
    return documents.detect_document_type(page_texts(x)).select("doc_id", "document_type", "document_label", "keyword_hits")


@case("D15", """SELECT d.doc_id, CASE WHEN n.n > 0 THEN 'DOC-FINAL-BILL' WHEN hits > 0 THEN best_type END AS document_type, COALESCE(n.n, 0) AS n_priced, n.n IS NULL AND hits = 0 AS rejected
 FROM detected d LEFT JOIN (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) n ON n.doc_id = d.doc_id""")
def d15(x):
    priced = x.table("lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("doc_id"))
    return documents.correct_document_type(documents.detect_document_type(page_texts(x)), priced).select("doc_id", "document_type", "n_priced", "rejected")


@case("SRC9", "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents")
def src9(x):
    return x.table("documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


# --- truth against extraction ---------------------------------------------------------------


def extracted(x) -> DataFrame:
    """What a reader might have seen of the bill lines: rows lost, amounts and heads misread, rows made up."""
    n = F.expr("line_no div 1000")
    seen = x.lines.where(n % 9 != 0).select(
        "tenant", "claim_id", "line_no", F.concat(F.upper("description"), F.lit("  ")).alias("description"),
        F.when(n % 8 == 0, "OTHER").otherwise(F.col("head")).alias("head"), (F.col("amount_paise") + F.when(n % 10 == 0, 100).otherwise(0)).alias("amount_paise"))
    made_up = x.lines.where(n % 50 == 0).select("tenant", "claim_id", "line_no", F.concat(F.lit("Ghost "), (n % 3).cast("string")).alias("description"), F.lit("OTHER").alias("head"), F.lit(500).cast("bigint").alias("amount_paise"))
    return seen.unionByName(made_up)


CTES["read_rows"] = """
SELECT tenant, claim_id, line_no, description || '  ' AS description, CASE WHEN (line_no // 1000) % 8 = 0 THEN 'OTHER' ELSE head END AS head,
 amount_paise + CASE WHEN (line_no // 1000) % 10 = 0 THEN 100 ELSE 0 END AS amount_paise FROM lines WHERE (line_no // 1000) % 9 <> 0
UNION ALL SELECT tenant, claim_id, line_no, 'ghost ' || (line_no // 1000) % 3, 'OTHER', 500 FROM lines WHERE (line_no // 1000) % 50 = 0"""


def _side(table: str) -> str:
    return (f"SELECT tenant, claim_id, lower(trim(description)) AS d, arg_max(amount_paise, line_no) AS a, arg_max(head, line_no) AS h, CAST(sum(amount_paise) AS BIGINT) AS total FROM {table} GROUP BY 1, 2, 3")


CTES["truth_rows"] = _side("lines")
CTES["got_rows"] = _side("read_rows")
CTES["compared_rows"] = """
SELECT COALESCE(t.tenant, g.tenant) AS tenant, COALESCE(t.claim_id, g.claim_id) AS claim_id, COALESCE(t.d, g.d) AS d, t.d IS NOT NULL AS in_t, g.d IS NOT NULL AS in_g,
 t.a = g.a AS a_ok, t.h = g.h AS h_ok, COALESCE(t.total, 0) AS tt, COALESCE(g.total, 0) AS gt
FROM truth_rows t FULL JOIN got_rows g ON g.tenant = t.tenant AND g.claim_id = t.claim_id AND g.d = t.d"""


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN '0.0000' ELSE {b.decimal_text(b.half_even(f'{num} * 10000', f'CASE WHEN {den} = 0 THEN 1 ELSE {den} END'), 4)} END"


@case("E5", f"""SELECT tenant, claim_id, e AS rows_expected, g AS rows_extracted, m AS rows_matched, {_ratio('m', 'e')} AS row_recall, {_ratio('a', 'm')} AS amount_accuracy, {_ratio('h', 'm')} AS head_accuracy,
 total_expected, total_got, total_expected = total_got AS total_exact, missed, hallucinated FROM (
 SELECT tenant, claim_id, count(*) FILTER (in_t) AS e, count(*) FILTER (in_g) AS g, count(*) FILTER (in_t AND in_g) AS m, count(*) FILTER (in_t AND in_g AND a_ok) AS a,
 count(*) FILTER (in_t AND in_g AND h_ok) AS h, CAST(sum(tt) AS BIGINT) AS total_expected, CAST(sum(gt) AS BIGINT) AS total_got,
 COALESCE(array_to_string(list_slice(list(d ORDER BY d) FILTER (NOT in_g), 1, 6), '|'), '') AS missed, COALESCE(array_to_string(list_slice(list(d ORDER BY d) FILTER (NOT in_t), 1, 6), '|'), '') AS hallucinated
 FROM compared_rows GROUP BY tenant, claim_id)""")
def e5(x):
    out = evaluate.compare_extraction(x.lines, extracted(x), ["tenant", "claim_id"])
    texts = [F.col(c).cast("string").alias(c) for c in ("row_recall", "amount_accuracy", "head_accuracy")] + [
        F.array_join(c, "|").alias(c) for c in ("missed", "hallucinated")]
    return out.select("tenant", "claim_id", "rows_expected", "rows_extracted", "rows_matched", *texts, "total_expected", "total_got", "total_exact")


@case("J10", "SELECT tenant, claim_id, d AS item, CASE WHEN NOT in_g THEN 'missed' WHEN NOT in_t THEN 'hallucinated' ELSE 'matched' END AS side FROM compared_rows")
def j10(x):
    key = lambda df: df.select("tenant", "claim_id", evaluate.tx.normalise_text(F.col("description")).alias("item")).distinct()
    t, e, on = key(x.lines), key(extracted(x)), ["tenant", "claim_id", "item"]
    tag = lambda df, s: df.withColumn("side", F.lit(s))
    return tag(t.join(e, on, "left_semi"), "matched").unionByName(tag(t.join(e, on, "left_anti"), "missed")).unionByName(tag(e.join(t, on, "left_anti"), "hallucinated"))


# --- labelled sets ------------------------------------------------------------------------------


@case("SRC8", """SELECT doc_id AS set_id, n AS line_no, 'Item ' || doc_id || '-' || n AS description, CASE n WHEN 1 THEN 'OTHER' ELSE 'ROOM' END AS head,
 CASE WHEN n = 1 AND toxic = 1 THEN 'LIST_I_OPTIONAL' WHEN n = 1 AND quality = 0 THEN 'UNMAPPED' ELSE 'PAYABLE' END AS expected FROM labels, (VALUES (1), (2)) AS t(n)""")
def src8(x):
    files = labelled_texts(x).select("set_id", F.from_json("json", records.LABELLED_ITEMS).alias("j")).select("set_id", "j.*")
    return records.labelled_items(files)


def labelled_texts(x) -> DataFrame:
    name = lambda n: F.concat(F.lit("Item "), F.col("doc_id").cast("string"), F.lit(f"-{n}"))
    first = F.when(F.col("toxic") == 1, "LIST_I_OPTIONAL").when(F.col("quality") == 0, "UNMAPPED").otherwise("PAYABLE")
    item = lambda n, head, cls: F.struct(name(n).alias("description"), F.lit(head).alias("head"), cls.alias("expected"))
    query = F.struct(name(1).alias("query"), F.array(first, F.lit("PAYABLE")).alias("expected"))
    json = F.to_json(F.struct(F.lit("made from labels").alias("_note"), F.array(item(1, "OTHER", first), item(2, "ROOM", F.lit("PAYABLE"))).alias("items"),
                              F.array(query).alias("queries")))
    return x.table("labels").select(F.col("doc_id").alias("set_id"), json.alias("json"), F.expr("doc_id div 500").alias("part"))


@case("SRC8F", """SELECT n AS line_no, 'Item ' || doc_id || '-' || n AS description, CASE n WHEN 1 THEN 'OTHER' ELSE 'ROOM' END AS head,
 CASE WHEN n = 1 AND toxic = 1 THEN 'LIST_I_OPTIONAL' WHEN n = 1 AND quality = 0 THEN 'UNMAPPED' ELSE 'PAYABLE' END AS expected FROM labels, (VALUES (1), (2)) AS t(n)""")
def src8f(x):
    """The same items, written to files and read by the reader of files."""
    return records.read_labelled_items(x.spark, b.json_files(x, labelled_texts(x), "items"))


@case("SRC8Q", """SELECT 0 AS pos, 'Item ' || doc_id || '-1' AS query, CASE WHEN toxic = 1 THEN 'LIST_I_OPTIONAL' WHEN quality = 0 THEN 'UNMAPPED' ELSE 'PAYABLE' END || ',PAYABLE' AS expected FROM labels""")
def src8q(x):
    return records.read_labelled_queries(x.spark, b.json_files(x, labelled_texts(x), "queries")).withColumn("expected", F.array_join("expected", ","))
