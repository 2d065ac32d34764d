"""Cases for retrieval and its evaluation: every benchmark text is a query, every document is ranked.

Vectors: a document has the embedding of its number, a query that of its item number.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.operators import classify, evaluate, intake, retrieval
from suite import base as b
from suite import core
from suite.base import CTES, case


def queries(x) -> DataFrame:
    return x.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


def docs(x) -> DataFrame:
    return x.table("documents").select("doc_id", F.col("doc_id").alias("doc_order"), "text")


def query_vectors(x) -> DataFrame:
    v = x.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return v.join(queries(x).select("query_id"), "query_id", "left_semi")


def doc_vectors(x) -> DataFrame:
    return x.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")).join(docs(x).select("doc_id"), "doc_id", "left_semi")


def hits(x, strategy: str, k: int = 5) -> DataFrame:
    return retrieval.search(queries(x), docs(x), k, strategy, query_vectors=query_vectors(x), doc_vectors=doc_vectors(x))


CTES["dq"] = "SELECT item_id AS query_id, text FROM benchmark"
CTES["dd"] = "SELECT doc_id, doc_id AS doc_order, text FROM documents"
CTES["dqv"] = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)"
CTES["ddv"] = "SELECT vec_id AS doc_id, vec_id AS doc_order, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)"
core.bm25_ctes("d", "dq", "dd")
core.dense_ctes("d", "dqv", "ddv")
core.fuse_ctes("d")
CTES["d_hits"] = """
SELECT 'rrf' AS strategy, query_id, rank, doc_id, bm25_rank, dense_rank FROM d_top
UNION ALL SELECT 'bm25', query_id, bm25_rank + 1, doc_id, bm25_rank, NULL FROM d_bm25 WHERE bm25_rank < 5
UNION ALL SELECT 'dense', n.query_id, n.dense_rank + 1, n.doc_id, w.bm25_rank, n.dense_rank FROM d_dense n
 LEFT JOIN (SELECT * FROM d_bm25 WHERE bm25_rank < 25) w ON w.query_id = n.query_id AND w.doc_id = n.doc_id WHERE n.dense_rank < 5"""


@case("R1", "SELECT query_id, doc_id, bm25_rank FROM d_bm25")
def r1(x):
    return retrieval.bm25_rank(queries(x), docs(x), pool=None).select("query_id", "doc_id", F.col("bm25_rank").cast("bigint").alias("bm25_rank"))


@case("R2", "SELECT query_id, doc_id, dense_rank FROM d_dense WHERE dense_rank < 25")
def r2(x):
    v = doc_vectors(x).withColumn("doc_order", F.col("doc_id"))
    return retrieval.dense_rank(query_vectors(x), v, doc_blocks=3, query_blocks=2).select("query_id", "doc_id", F.col("dense_rank").cast("bigint").alias("dense_rank"))


@case("R3", "SELECT query_id, doc_id, bm25_rank, dense_rank FROM d_rrf")
def r3(x):
    words = retrieval.bm25_rank(queries(x), docs(x))
    near = retrieval.dense_rank(query_vectors(x), doc_vectors(x).withColumn("doc_order", F.col("doc_id")))
    return retrieval.rrf_fuse(words, near).select("query_id", "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("bm25_rank", "dense_rank")])


@case("J9", "SELECT query_id, count(*) AS n, count(bm25_rank) AS words, count(dense_rank) AS vectors, count(CASE WHEN bm25_rank IS NOT NULL AND dense_rank IS NOT NULL THEN 1 END) AS in_both FROM d_rrf GROUP BY query_id")
def j9(x):
    words = retrieval.bm25_rank(queries(x), docs(x))
    near = retrieval.dense_rank(query_vectors(x), doc_vectors(x).withColumn("doc_order", F.col("doc_id")))
    fused = retrieval.rrf_fuse(words, near)
    return fused.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("bm25_rank").alias("words"), F.count("dense_rank").alias("vectors"),
        F.count(F.when(F.col("bm25_rank").isNotNull() & F.col("dense_rank").isNotNull(), 1)).alias("in_both"))


_H = ["query_id", "rank", "doc_id", "bm25_rank", "dense_rank"]


@case("R4", f"SELECT {', '.join(_H)} FROM d_hits WHERE strategy = 'rrf'")
def r4(x):
    return hits(x, "rrf").select(*[F.col(c).cast("bigint").alias(c) for c in _H])


@case("R5", "SELECT query_id, bm25_rank + 1 AS rank, doc_id FROM d_bm25 WHERE bm25_rank < 5")
def r5(x):
    return retrieval.search(queries(x), docs(x), 5, "rrf").select(*[F.col(c).cast("bigint").alias(c) for c in ("query_id", "rank", "doc_id")])


def compared(x) -> DataFrame:
    if not hasattr(x, "_compared"):
        x._compared = retrieval.compare_strategies(queries(x), docs(x), query_vectors=query_vectors(x), doc_vectors=doc_vectors(x))
    return x._compared


@case("R6", f"SELECT strategy, {', '.join(_H)} FROM d_hits")
def r6(x):
    return compared(x).select("strategy", *[F.col(c).cast("bigint").alias(c) for c in _H])


# Labels: document d is the answer to query d mod (number of queries).
CTES["d_labels"] = "SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS query_id FROM documents"
CTES["d_flags"] = """
SELECT q.item_id AS query_id, s.strategy, COALESCE(min(h.rank) <= 1, FALSE) AS hit_1, COALESCE(min(h.rank) <= 3, FALSE) AS hit_3, COALESCE(min(h.rank) <= 5, FALSE) AS hit_5
FROM benchmark q CROSS JOIN (VALUES ('bm25'), ('dense'), ('rrf')) AS s(strategy)
LEFT JOIN (SELECT h.* FROM d_hits h JOIN d_labels l ON l.query_id = h.query_id AND l.doc_id = h.doc_id) h ON h.query_id = q.item_id AND h.strategy = s.strategy
GROUP BY ALL"""


def flags(x) -> DataFrame:
    n = queries(x).agg(F.count(F.lit(1))).scalar()
    expected = docs(x).select("doc_id").withColumn("n", n).select("doc_id", F.pmod("doc_id", "n").alias("query_id"))
    return evaluate.hit_flags(compared(x), expected)


CTES["d_recall"] = "SELECT strategy, count(*) AS n, " + ", ".join(
    f"{b.half_even(f'count(*) FILTER (hit_{k}) * 10000', 'count(*)')} AS r{k}" for k in (1, 3, 5)) + " FROM d_flags GROUP BY strategy"


@case("E3", "SELECT strategy, n, " + ", ".join(f"{b.decimal_text(f'r{k}', 4)} AS recall_{k}" for k in (1, 3, 5)) + " FROM d_recall")
def e3(x):
    return evaluate.recall_at_k(flags(x)).select("strategy", "n", *[F.col(f"recall_{k}").cast("string").alias(f"recall_{k}") for k in (1, 3, 5)])


@case("E4", f"""SELECT query_id, strategy, (SELECT {b.decimal_text("max(r5) FILTER (strategy = 'rrf') - max(r5) FILTER (strategy <> 'rrf')", 4)} FROM d_recall) AS delta FROM d_flags WHERE NOT hit_5""")
def e4(x):
    f = classify.sized(flags(x))  # read twice
    delta = evaluate.fusion_delta(evaluate.recall_at_k(f)).scalar()
    return evaluate.misses(f).withColumn("delta", delta.cast("string"))


# --- classification scores -----------------------------------------------------------

# Expected class of every kind of line, by description; some differ from the catalogue on purpose.
EXPECTED = {
    "visitor meals x2": "LIST_I_OPTIONAL", "telephone usage": "LIST_I_OPTIONAL", "tv hire / day": "LIST_I_OPTIONAL", "laundry": "LIST_II_ROOM",
    "patient gown": "LIST_II_ROOM", "disposable cap": "LIST_III_PROCEDURE", "housekeeping fee": "LIST_II_ROOM", "bed pan steel": "LIST_II_ROOM",
    "sterile gloves 7.5": "LIST_III_PROCEDURE", "drape sheet": "LIST_III_PROCEDURE", "surgical blade 15": "LIST_III_PROCEDURE",
    "gauze roll": "LIST_III_PROCEDURE", "sterilisation fee": "LIST_III_PROCEDURE", "registration fee": "PAYABLE",
    "medical records fee": "LIST_IV_TREATMENT", "capsule strip": "PAYABLE", "misc chg 4471": "UNMAPPED", "sundry": "LIST_IV_TREATMENT",
    "urine bag": "LIST_IV_TREATMENT",
}
CTES["labels_by_text"] = "SELECT * FROM (VALUES " + ", ".join(f"({b.q(d)}, {b.q(c)})" for d, c in EXPECTED.items()) + ") AS e(item, expected)"


def expected_class(description):
    from auditlens.functions import text as tx
    from auditlens.functions.vocabulary import lookup
    return F.coalesce(lookup(tx.item_key(description), EXPECTED), F.lit("PAYABLE"))


_STRATEGIES = (("head_only", "f_head_only"), ("keyword", "f_keyword"), ("retrieval", "f_retrieval"), ("deterministic", "f_determined"))
CTES["judged"] = " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, COALESCE(e.expected, 'PAYABLE') AS expected, f.classification AS got, f.cited_chunk_id FROM {c} f LEFT JOIN labels_by_text e ON e.item = lower(trim(f.description))"
    for s, c in _STRATEGIES)


def judged(x) -> DataFrame:
    out = None
    for s, _ in _STRATEGIES:
        part = x.findings(s).select(F.lit(s).alias("strategy"), expected_class(F.col("description")).alias("expected"),
                                    F.col("classification").alias("got"), "cited_chunk_id")
        out = part if out is None else out.unionByName(part)
    return out


@case("J11", "SELECT strategy, expected, got, count(*) AS n FROM judged GROUP BY ALL")
def j11(x):
    return judged(x).groupBy("strategy", "expected", "got").agg(F.count(F.lit(1)).alias("n"))


def rate(num: str, den: str, empty: int) -> str:
    return f"CASE WHEN ({den}) = 0 THEN '{empty}.0000' ELSE {b.decimal_text(b.half_even(f'({num}) * 10000', f'CASE WHEN ({den}) = 0 THEN 1 ELSE ({den}) END'), 4)} END"


_SCORES = f"""count(*) AS n, {rate('count(*) FILTER (expected = got)', 'count(*)', 0)} AS accuracy,
 {rate("count(*) FILTER (expected <> 'PAYABLE' AND expected = got)", "count(*) FILTER (expected <> 'PAYABLE')", 0)} AS non_payable_recall,
 {rate("count(*) FILTER (expected = 'PAYABLE' AND got LIKE 'LIST_%')", "count(*) FILTER (expected = 'PAYABLE')", 0)} AS false_deduction_rate,
 {rate("count(*) FILTER (got LIKE 'LIST_%' AND cited_chunk_id IS NOT NULL)", "count(*) FILTER (got LIKE 'LIST_%')", 1)} AS citation_rate"""
_RATES = ("accuracy", "non_payable_recall", "false_deduction_rate", "citation_rate")


@case("E1", f"SELECT strategy, {_SCORES} FROM judged GROUP BY strategy")
def e1(x):
    return evaluate.score_classification(judged(x), ["strategy"]).select("strategy", "n", *[F.col(c).cast("string").alias(c) for c in _RATES])


@case("E2", "SELECT strategy, expected, got, count(*) AS n FROM judged WHERE expected <> got GROUP BY ALL")
def e2(x):
    return evaluate.confusion(judged(x), ["strategy"])


CTES["swept"] = """
SELECT g.gate, COALESCE(e.expected, 'PAYABLE') AS expected, CASE WHEN n.cosine >= g.gate THEN n.list_name ELSE 'PAYABLE' END AS got, CASE WHEN n.cosine >= g.gate THEN n.chunk_id END AS cited_chunk_id
FROM lines l LEFT JOIN labels_by_text e ON e.item = lower(trim(l.description)) LEFT JOIN nearest n ON l.head = 'OTHER' AND n.text = lower(l.description),
 (VALUES (0.65), (0.70), (0.82), (0.90)) AS g(gate)"""


@case("E7", f"SELECT CAST(gate AS VARCHAR) AS gate, {_SCORES} FROM swept GROUP BY gate")
def e7(x):
    texts = classify.sized(classify.other_texts(x.lines))
    near = classify.sized(classify.nearest_listed(texts, x.rules, *x.vectors))
    keyed = x.lines.select("claim_id", "line_no", expected_class(F.col("description")).alias("expected"), F.when(F.col("head") == "OTHER", F.lower("description")).alias("text"))
    scored = classify.salted_left_join(keyed, near, "text", ["claim_id", "line_no"])
    gates = tuple(Decimal(g) for g in ("0.65", "0.70", "0.82", "0.90"))
    return evaluate.threshold_sweep(scored, gates).select(F.col("gate").cast("string").alias("gate"), "n", *[F.col(c).cast("string").alias(c) for c in _RATES])


# --- model hook ------------------------------------------------------------------------


def text_hits(x) -> DataFrame:
    texts = classify.sized(classify.other_texts(x.lines))
    tv, rv = x.vectors
    rule_docs = x.rules.select(F.col("chunk_id").alias("doc_id"), F.concat_ws("#", "path", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("doc_order"),
                               classify.tx.search_text(F.col("title"), F.col("aliases"), F.col("body")).alias("text"))
    return retrieval.search(texts.select(F.col("text").alias("query_id"), "text"), rule_docs, 5, "rrf",
                            query_vectors=tv.withColumnRenamed("text", "query_id"), doc_vectors=rv.withColumnRenamed("chunk_id", "doc_id"))


CTES["candidates"] = """
SELECT t.query_id AS text, string_agg(t.rank || ' ' || t.doc_id || ' ' || COALESCE(r.list_name, r.topic, 'policy') || ' ' || array_to_string(list_slice(r.aliases, 1, 6), '/'), '; ' ORDER BY t.rank) AS candidates
FROM cr_top t JOIN rules r ON r.chunk_id = t.doc_id GROUP BY 1"""


@case("U2", "SELECT l.head, c.text, c.candidates, count(*) AS n FROM lines l JOIN candidates c ON l.head = 'OTHER' AND c.text = lower(l.description) GROUP BY ALL")
def u2(x):
    block = retrieval.candidate_block(text_hits(x), x.rules)
    shown = block.select(F.col("query_id").alias("text"), F.array_join(F.transform("candidates", lambda c: F.concat_ws(
        " ", c["rank"].cast("string"), c["doc_id"], c["tag"], F.array_join(c["aliases"], "/"))), "; ").alias("candidates"))
    counts = x.lines.where("head = 'OTHER'").groupBy("head", F.lower("description").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(shown, "text").select("head", "text", "candidates", "n")


@case("U1", """SELECT l.tenant, l.claim_id, l.line_no, CASE WHEN l.head = 'OTHER' AND r.list_name IS NOT NULL THEN r.list_name ELSE 'PAYABLE' END AS classification,
 CASE WHEN l.head = 'OTHER' AND r.list_name IS NOT NULL THEN r.chunk_id END AS cited_chunk_id
 FROM lines l LEFT JOIN (SELECT * FROM cr_top WHERE rank = 1) t ON l.head = 'OTHER' AND t.query_id = lower(l.description) LEFT JOIN rules r ON r.chunk_id = t.doc_id""")
def u1(x):
    block = retrieval.candidate_block(text_hits(x), x.rules).withColumnRenamed("query_id", "text")
    verdicts = intake.model_scorer(x.lines, block)
    return verdicts.select("tenant", "claim_id", "line_no", "classification", "cited_chunk_id")
