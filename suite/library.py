"""Cases for the rule catalogue, over rule files and a source registry written from `part` and `supplier`.

Every part becomes a markdown file with three rules, some of them faulty; every supplier an entry of the registry.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.rows import spread
from auditlens.operators import assess, portfolio
from auditlens.plans.audit import corpus_version
from auditlens.sources import rules as rf
from suite import base as b
from suite.base import CTES, case

_LISTS = ("LIST_I_OPTIONAL", "LIST_II_ROOM", "LIST_III_PROCEDURE", "LIST_IV_TREATMENT")


def rule_texts(x) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    block = F.concat(
        F.lit("<!-- source:\njurisdiction: IN\nlist: "), F.element_at(F.array(*[F.lit(v) for v in _LISTS]), (k % 4 + 1).cast("int")),
        F.lit("\nseverity: "), F.when(k % 11 == 0, "LOUD").otherwise("WARNING"), F.lit("\nsource_id: SRC-"), s(k % 120),
        F.lit("\ncitation: "), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("Part "), "p_type")), F.lit("\ncitation_precision: list\n-->\n\n"))
    text = F.concat(
        F.lit("# "), "p_brand", F.lit("\n\n"), F.when(k % 17 == 0, "").otherwise(block),
        F.lit("<!-- chunk_id: "), F.when(k % 19 == 0, F.concat(F.lit("DUP-"), s(k % 5))).otherwise(F.concat(F.lit("P"), s(k), F.lit("-A"))),
        F.lit(" | bearer: HOSPITAL -->\n### "), "p_name", F.lit("\nAliases: "), "p_name", F.lit(",  "), "p_brand", F.lit(" ,, "), "p_type",
        F.lit("\nBody   of "), "p_type", F.lit("\n  second line.\n\n<!-- chunk_id: P"), s(k),
        F.lit("-B | list: LIST_I_OPTIONAL | severity: INFO | citation_precision: item -->\n## "), "p_name", F.lit(" plus\nOnly body "), s(F.col("p_size")),
        F.lit(".\n\n<!-- chunk_id: P"), s(k), F.lit("-C | topic: copay -->\nNo heading here, size "), s(F.col("p_size")), F.lit(".\n"))
    parts = spread(x.table("part"), 20_000, "p_partkey")  # the table is some 10 bytes a row, parsing a file takes most of a millisecond
    return parts.select(F.concat(F.lit("parts/"), F.lpad(s(k), 9, "0"), F.lit(".md")).alias("path"), text.alias("text"))


CTES["part_rules"] = """
SELECT 'parts/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.md' AS path, i AS pos, p_partkey AS k,
 CASE i WHEN 0 THEN CASE WHEN p_partkey % 19 = 0 THEN 'DUP-' || p_partkey % 5 ELSE 'P' || p_partkey || '-A' END WHEN 1 THEN 'P' || p_partkey || '-B' ELSE 'P' || p_partkey || '-C' END AS chunk_id,
 CASE i WHEN 0 THEN p_name WHEN 1 THEN p_name || ' plus' ELSE 'P' || p_partkey || '-C' END AS title,
 CASE i WHEN 0 THEN [p_name, p_brand, p_type] ELSE [] END AS aliases,
 CASE i WHEN 0 THEN 'Body of ' || p_type || ' second line.' WHEN 1 THEN 'Only body ' || p_size || '.' ELSE 'No heading here, size ' || p_size || '.' END AS body,
 CASE WHEN p_partkey % 17 <> 0 THEN 'IN' END AS jurisdiction,
 CASE WHEN i = 1 THEN 'INFO' WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'LOUD' ELSE 'WARNING' END AS severity,
 CASE WHEN p_partkey % 17 <> 0 THEN 'SRC-' || p_partkey % 120 END AS source_id,
 CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '' ELSE 'Part ' || p_type END AS citation,
 CASE WHEN i = 1 THEN 'item' WHEN p_partkey % 17 <> 0 THEN 'list' END AS citation_precision,
 CASE WHEN i = 1 THEN 'LIST_I_OPTIONAL' WHEN p_partkey % 17 <> 0 THEN ['LIST_I_OPTIONAL', 'LIST_II_ROOM', 'LIST_III_PROCEDURE', 'LIST_IV_TREATMENT'][p_partkey % 4 + 1] END AS list_name,
 CASE WHEN i = 0 THEN 'HOSPITAL' END AS bearer, CASE WHEN i = 2 THEN 'copay' END AS topic
FROM part, (VALUES (0), (1), (2)) AS t(i)"""


def rules(x) -> DataFrame:
    return rf.parse_rules(rule_texts(x))


def source_texts(x) -> DataFrame:
    k = F.col("s_suppkey")
    s = lambda c: c.cast("string")
    verified = F.when(k % 4 != 0, F.concat(F.lit("verified_on = "), s(F.date_add(F.lit(dt.date(2024, 6, 1)), (k % 500).cast("int"))), F.lit("\n"))).otherwise("")
    text = F.concat(
        F.lit('# registry\n[[source]]\nsource_id = "SRC-'), s(k), F.lit('"\njurisdiction = "IN"\ntitle = "'), "s_name", F.lit('"\n'),
        F.when(k % 3 == 0, F.concat(F.lit('reference = "REF/'), s(k), F.lit('"\n'))).otherwise('reference = ""\n'),
        F.lit("published = 2020-01-02\nretrieved = 2025-02-03\n"), verified,
        F.lit('status = "'), F.when(k % 7 == 0, "superseded").when(k % 5 == 0, "unverified").otherwise("in_force"), F.lit('"\n'),
        F.when(k % 14 == 0, F.concat(F.lit('superseded_by = "SRC-'), s(k + 1), F.lit('"\n'))).otherwise(""),
        F.lit('note = """\nFirst line of '), "s_name", F.lit('.\nSecond line.\n"""\n'))
    return x.table("supplier").select(F.concat(F.lit("s/"), s(k), F.lit(".toml")).alias("path"), text.alias("text"))


CTES["supp_sources"] = """
SELECT 'SRC-' || s_suppkey AS source_id, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'REF/' || s_suppkey ELSE '' END AS reference,
 CASE WHEN s_suppkey % 7 = 0 THEN 'superseded' WHEN s_suppkey % 5 = 0 THEN 'unverified' ELSE 'in_force' END AS status,
 CASE WHEN s_suppkey % 14 = 0 THEN 'SRC-' || (s_suppkey + 1) END AS superseded_by,
 CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2024-06-01' + CAST(s_suppkey % 500 AS INTEGER) END AS verified_on,
 'First line of ' || s_name || '.' || chr(10) || 'Second line.' || chr(10) AS note FROM supplier"""


def sources(x) -> DataFrame:
    return rf.parse_sources(source_texts(x))


@case("SRC3", "SELECT path, pos, chunk_id, title, array_to_string(aliases, '|') AS aliases, body FROM part_rules")
def src3(x):
    return rules(x).select("path", "pos", "chunk_id", "title", F.array_join("aliases", "|").alias("aliases"), "body")


_META = ["jurisdiction", "severity", "source_id", "citation", "citation_precision", "list_name", "bearer", "topic"]


@case("SRC4", "SELECT path, pos, " + ", ".join(_META) + " FROM part_rules")
def src4(x):
    return rules(x).select("path", "pos", *_META)


CTES["violations"] = """
SELECT path, chunk_id, 'file has no source block' AS problem FROM part_rules WHERE k % 17 = 0
UNION ALL SELECT path, NULL, 'file has no source block' FROM part_rules WHERE k % 17 = 0 AND pos = 0
UNION ALL SELECT path, chunk_id, 'missing citation' FROM part_rules WHERE k % 17 <> 0 AND k % 13 = 0
UNION ALL SELECT path, chunk_id, 'unknown severity' FROM part_rules WHERE severity = 'LOUD'
UNION ALL SELECT min(path), chunk_id, 'duplicate chunk_id' FROM part_rules GROUP BY chunk_id HAVING count(*) > 1
UNION ALL SELECT path, chunk_id, 'unknown source_id' FROM part_rules WHERE source_id NOT IN (SELECT source_id FROM supp_sources)"""


@case("SRC5", "SELECT path, chunk_id, problem FROM violations GROUP BY ALL")
def src5(x):
    return rf.rule_violations(rules(x), sources(x), rule_texts(x))


@case("SRC6", "SELECT source_id, title, reference, status, superseded_by, CAST(verified_on AS VARCHAR) AS verified_on, note FROM supp_sources")
def src6(x):
    return sources(x).select("source_id", "title", "reference", "status", "superseded_by", F.col("verified_on").cast("string").alias("verified_on"), "note")


CTES["stale"] = """
SELECT source_id, title, CASE WHEN status = 'superseded' THEN 'Replaced; the text now in force: ' || COALESCE(superseded_by, 'not recorded')
 WHEN status = 'unverified' OR verified_on IS NULL THEN 'Nobody has compared this with the published text.'
 WHEN DATE '2026-01-01' - verified_on > 365 THEN 'Compared on ' || verified_on || ', which is ' || (DATE '2026-01-01' - verified_on) || ' days back.' END AS reason FROM supp_sources"""


@case("FN22", "SELECT source_id, reason FROM stale")
def fn22(x):
    reason = tx.staleness(F.col("status"), F.col("superseded_by"), F.col("verified_on"), F.lit(b.TODAY))
    return sources(x).select("source_id", reason.alias("reason"))


@case("J8", "SELECT source_id, title, reason FROM stale WHERE reason IS NOT NULL AND source_id IN (SELECT source_id FROM part_rules)")
def j8(x):
    return assess.stale_sources(rules(x), sources(x), b.TODAY)


@case("FN23", """SELECT path, pos, COALESCE(NULLIF(s.reference, ''), s.title, r.source_id) || ', ' || citation AS attribution
 FROM part_rules r LEFT JOIN supp_sources s ON s.source_id = r.source_id""")
def fn23(x):
    s = sources(x).select("source_id", "reference", F.col("title").alias("source_title"))
    return rules(x).join(s, "source_id", "left").select(
        "path", "pos", tx.attribution(F.col("reference"), F.col("source_title"), F.col("source_id"), F.col("citation")).alias("attribution"))


@case("FN24", "SELECT path, pos, title || '. ' || array_to_string(aliases, ' ') || '. ' || body AS text FROM part_rules")
def fn24(x):
    return rules(x).select("path", "pos", tx.search_text(F.col("title"), F.col("aliases"), F.col("body")).alias("text"))


_RULE_LANES = ", ".join(f"sum(CAST('0x' || substr(h, {i * 15 + 1}, 15) AS BIGINT)) AS s{i}" for i in range(4))


@case("FN26", f"""SELECT 'unverified-' || left(sha256(concat_ws('|', n_rules, s0, s1, s2, s3)), 10) AS corpus_version, n_rules FROM (SELECT count(*) AS n_rules, {_RULE_LANES} FROM (
 SELECT sha256(concat_ws(chr(31), path, pos, chunk_id, title || '. ' || array_to_string(aliases, ' ') || '. ' || body,
 COALESCE(jurisdiction, ''), COALESCE(severity, ''), COALESCE(source_id, ''), COALESCE(citation, ''), COALESCE(citation_precision, ''), COALESCE(list_name, ''),
 COALESCE(bearer, ''), COALESCE(topic, ''))) AS h FROM part_rules))""")
def fn26(x):
    return corpus_version(rules(x), sources(x), b.TODAY)


@case("FL6", """SELECT path, pos, chunk_id FROM part_rules WHERE COALESCE(list_name, 'POLICY_WORDING') = 'LIST_II_ROOM' AND (contains(lower(title), 'red')
 OR contains(lower(body), 'red') OR contains(lower(chunk_id), 'red') OR len(list_filter(aliases, lambda a: contains(lower(a), 'red'))) > 0)""")
def fl6(x):
    return portfolio.rules_search(rules(x), "Red", "LIST_II_ROOM").select("path", "pos", "chunk_id")


@case("FL7", "SELECT path, pos, title, body FROM part_rules WHERE chunk_id = 'P42-B'")
def fl7(x):
    return portfolio.rule(rules(x), "P42-B").select("path", "pos", "title", "body")


@case("P10", "SELECT COALESCE(list_name, 'POLICY_WORDING') AS list, count(*) AS n, (SELECT max(verified_on) FROM supp_sources) AS verified_on FROM part_rules GROUP BY 1")
def p10(x):
    return portfolio.rules_catalog_counts(rules(x), sources(x))


@case("P11", "SELECT COALESCE(list_name, topic, 'policy') AS name, count(*) AS n FROM part_rules GROUP BY 1")
def p11(x):
    return portfolio.corpus_counts(rules(x))


@case("P9", """SELECT c AS classification, count(*) AS n FROM (SELECT classification AS c FROM findings WHERE classification IN ('LIST_II_ROOM', 'LIST_III_PROCEDURE', 'LIST_IV_TREATMENT')) GROUP BY c""")
def p9(x):
    return x.audit.findings.where(F.col("classification").isin(*portfolio.RECOVERABLE)).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
