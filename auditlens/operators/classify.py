"""Bill-line classification: every strategy works on distinct descriptions, then joins back once.

A verdict table has one row per distinct lower-cased description of a line under head OTHER:
(text, classification, cited_chunk_id, detail, confidence, source). Lines under any other head are a
primary service and payable whatever their text says; they never reach the matcher.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.rows import salted_left_join, sized
from auditlens.functions.vocabulary import bearer_of, fallback_severity, is_listed
from auditlens.operators import retrieval

# --- fixed values: gate and pool sizes that decide results ---
COSINE_GATE = 0.82
CANDIDATES = 5
# --- end of fixed values ---

_WORD = r"(?U)(\w+)"
_GRAM = r"(?s)(.[ \-].)"


def alias_index(rules: DataFrame) -> DataFrame:
    """One row per alias of a rule that names a list, with its pattern, its precedence and its anchors.

    An anchor is a piece of text every match is bound to contain: a whole word for one-word aliases, the
    three characters round the first separator for the others. It turns the pattern match into an
    equi-join; '*' is for the rare alias that has neither.
    """
    rows = rules.where(F.coalesce(F.col("list_name"), F.lit("")) != "").select(
        "path", "pos", "chunk_id", "list_name", "title", F.posexplode("aliases").alias("alias_pos", "raw"))
    alias = F.col("alias")
    spaced = alias.rlike("[ \\-]")
    runs = F.regexp_extract_all(alias, F.lit(_WORD), 1)
    word = F.element_at(runs, 1)
    gram = F.regexp_extract(alias, _GRAM, 1)
    return (
        rows.withColumn("alias", tx.strip(F.lower("raw"))).where(alias != "")
        .select(
            "path", "pos", "alias_pos", "chunk_id", "list_name", "title", "alias",
            F.length(alias).alias("alias_len"),
            spaced.alias("is_phrase"),
            F.concat(F.lit(r"(?U)\b\Q"), F.replace(alias, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\Es?\b")).alias("pattern"),
            F.when(spaced, F.array(F.when(gram != "", F.concat(F.lit("g:"), gram)).otherwise(F.lit("*"))))
            .when(F.size(runs) == 0, F.array(F.lit("*")))
            .when((F.size(runs) == 1) & alias.endswith(word),
                  F.array(F.concat(F.lit("w:"), word), F.concat(F.lit("w:"), word, F.lit("s"))))
            .otherwise(F.array(F.concat(F.lit("w:"), word))).alias("anchors"),
        )
    )


def text_anchors(text: Column) -> Column:
    size = F.length(text)
    words = F.transform(F.regexp_extract_all(text, F.lit(_WORD), 1), lambda w: F.concat(F.lit("w:"), w))
    inner = F.filter(F.sequence(F.lit(2), F.greatest(size - 1, F.lit(2))),
                     lambda i: (i < size) & F.substring(text, i, F.lit(1)).isin(" ", "-"))
    grams = F.transform(inner, lambda i: F.concat(F.lit("g:"), F.substring(text, i - 1, F.lit(3))))
    return F.array_distinct(F.concat(words, grams, F.array(F.lit("*"))))


def alias_matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text, path, pos, alias_pos, chunk_id, list_name, title, alias, alias_len) for every alias found in a text."""
    index = alias_index(rules).withColumn("anchor", F.explode("anchors")).drop("anchors")
    keyed = texts.select("text", F.explode(text_anchors(F.col("text"))).alias("anchor"))
    found = F.when(F.col("is_phrase"), F.col("text").contains(F.col("alias"))).otherwise(F.expr("text rlike pattern"))
    return keyed.join(index, "anchor").where(found).drop("anchor", "pattern", "is_phrase")


def best_alias(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest alias wins; equal lengths go to the earlier rule of the catalogue."""
    order = F.struct(-F.col("alias_len"), "path", "pos", "alias_pos")
    hit = F.struct("chunk_id", "list_name", "title", "alias")
    return alias_matches(texts, rules).groupBy("text").agg(F.min_by(hit, order).alias("hit")).select("text", "hit.*")


def other_texts(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("head") == "OTHER").select(F.lower("description").alias("text")).distinct()


# --- verdicts per distinct text ------------------------------------------


def alias_verdicts(texts: DataFrame, rules: DataFrame) -> DataFrame:
    hit = F.col("chunk_id").isNotNull()
    return texts.join(best_alias(texts, rules), "text", "left").select(
        "text",
        F.when(hit, F.col("list_name")).otherwise("PAYABLE").alias("classification"),
        F.col("chunk_id").alias("cited_chunk_id"),
        F.when(hit, F.concat(F.lit("Catalogue entry '"), "title", F.lit("' found through '"), "alias", F.lit("'.")))
        .otherwise("No catalogue entry fits this description.").alias("reason"),
        F.lit(1.0).alias("confidence"), F.lit("keyword").alias("source"),
    )


def head_only_verdicts(texts: DataFrame) -> DataFrame:
    """Control: everything under OTHER is guessed to belong to the room."""
    return texts.select(
        "text", F.lit("LIST_II_ROOM").alias("classification"), F.lit(None).cast("string").alias("cited_chunk_id"),
        F.lit("Guess from the billing head alone.").alias("reason"),
        F.lit(1.0).alias("confidence"), F.lit("keyword").alias("source"))


def nearest_listed(texts: DataFrame, rules: DataFrame, text_vectors: DataFrame | None = None,
                   rule_vectors: DataFrame | None = None) -> DataFrame:
    """Per text the listed rule of highest cosine among the fused top five (text, hit, cosine)."""
    docs = rules.select(
        F.col("chunk_id").alias("doc_id"), F.concat_ws("#", "path", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("doc_order"),
        tx.search_text(F.col("title"), F.col("aliases"), F.col("body")).alias("text"))
    queries = texts.select(F.col("text").alias("query_id"), "text")
    hits = retrieval.search(
        queries, docs, k=CANDIDATES, strategy="rrf",
        query_vectors=None if text_vectors is None else text_vectors.withColumnRenamed("text", "query_id"),
        doc_vectors=None if rule_vectors is None else rule_vectors.withColumnRenamed("chunk_id", "doc_id"))
    listed = rules.where(F.coalesce(F.col("list_name"), F.lit("")) != "").select(F.col("chunk_id").alias("doc_id"), "list_name", "title")
    best = hits.join(listed, "doc_id").groupBy("query_id").agg(
        F.min_by(F.struct(F.col("doc_id").alias("chunk_id"), "list_name", "title", "cosine"),
                 F.struct(-F.col("cosine"), F.col("rank"))).alias("hit"))
    return best.select(F.col("query_id").alias("text"), "hit.*")


def retrieval_verdicts(texts: DataFrame, rules: DataFrame, text_vectors: DataFrame | None = None,
                       rule_vectors: DataFrame | None = None, gate: float = COSINE_GATE) -> DataFrame:
    near = nearest_listed(texts, rules, text_vectors, rule_vectors)
    none, low = F.col("chunk_id").isNull(), F.col("cosine") < gate
    percent = F.format_number("cosine", 2)
    return texts.join(near, "text", "left").select(
        "text",
        F.when(none | low, "PAYABLE").otherwise(F.col("list_name")).alias("classification"),
        F.when(~(none | low), F.col("chunk_id")).alias("cited_chunk_id"),
        F.when(none, "No listed rule came up.")
        .when(low, F.concat(F.lit("Nearest entry '"), "title", F.lit("' reached "), percent, F.lit(f", under the gate of {gate}.")))
        .otherwise(F.concat(F.lit("Nearest entry '"), "title", F.lit("'."))).alias("reason"),
        F.when(none, 1.0).otherwise(F.col("cosine")).alias("confidence"), F.lit("retrieval").alias("source"))


def deterministic_verdicts(texts: DataFrame, rules: DataFrame, text_vectors: DataFrame | None = None,
                           rule_vectors: DataFrame | None = None) -> DataFrame:
    """Aliases first, retrieval for the rest; a text neither knows is UNMAPPED, not payable."""
    by_alias = alias_verdicts(texts, rules)
    if text_vectors is None or rule_vectors is None:
        # Without vectors every cosine is 0 and stays under the gate.
        other = texts.select("text", F.lit("PAYABLE").alias("r_class"), F.lit(None).cast("string").alias("r_chunk"),
                             F.lit("").alias("r_reason"), F.lit(0.0).alias("r_confidence"))
    else:
        other = retrieval_verdicts(texts, rules, text_vectors, rule_vectors).select(
            "text", F.col("classification").alias("r_class"), F.col("cited_chunk_id").alias("r_chunk"),
            F.col("reason").alias("r_reason"), F.col("confidence").alias("r_confidence"))
    alias_hit, near_hit = F.col("classification") != "PAYABLE", F.col("r_class") != "PAYABLE"

    def pick(alias: Column, near: Column, neither: Column) -> Column:
        return F.when(alias_hit, alias).when(near_hit, near).otherwise(neither)

    return by_alias.join(other, "text").select(
        "text",
        pick(F.col("classification"), F.col("r_class"), F.lit("UNMAPPED")).alias("classification"),
        pick(F.col("cited_chunk_id"), F.col("r_chunk"), F.lit(None)).alias("cited_chunk_id"),
        pick(F.col("reason"), F.col("r_reason"),
             F.lit("No catalogue entry fits, and the head names no primary service. Needs manual review.")).alias("reason"),
        pick(F.col("confidence"), F.col("r_confidence"), F.col("r_confidence")).alias("confidence"),
        pick(F.lit("keyword"), F.lit("retrieval"), F.lit("retrieval")).alias("source"))


# --- verdict -> finding ----------------------------------------------------


def enrich(verdicts: DataFrame, rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach what the cited rule says about itself: bearer, severity, citation, source, title."""
    known = rules.join(sources.select("source_id", "reference", F.col("title").alias("source_title")), "source_id", "left").select(
        F.col("chunk_id").alias("cited_chunk_id"), F.col("bearer").alias("rule_bearer"), F.col("severity").alias("rule_severity"),
        F.col("title").alias("rule_title"), "source_id",
        tx.attribution(F.col("reference"), F.col("source_title"), F.col("source_id"), F.col("citation")).alias("citation"))
    return verdicts.join(known, "cited_chunk_id", "left")


def as_findings(judged: DataFrame) -> DataFrame:
    """Lines with verdict and rule columns -> findings. One finding per line."""
    cls, amount = F.col("classification"), F.col("amount_paise")
    listed = is_listed(cls)
    deducted = F.when(listed, amount).otherwise(F.lit(0).cast("bigint"))
    return judged.select(
        "tenant", "claim_id", "line_no", "description", "head", "quantity", "unit_rate_paise", "amount_paise",
        "service_date", "extract_confidence", "outside_stay",
        (F.col("outside_number") if "outside_number" in judged.columns else F.col("outside_stay")).alias("outside_number"), "classification",
        F.coalesce(F.nullif("rule_bearer", F.lit("")), bearer_of(cls)).alias("bearer"),
        deducted.alias("deducted_paise"), "reason", "confidence", "cited_chunk_id", "source",
        F.coalesce("cited_chunk_id", F.lit("")).alias("rule_id"),
        F.coalesce("rule_severity", fallback_severity(cls)).alias("severity"),
        F.coalesce("citation", F.lit("")).alias("citation"), F.coalesce("source_id", F.lit("")).alias("source_id"),
        F.lit("line_items.description").alias("field"), F.col("description").alias("observed"),
        F.when(listed & F.col("rule_title").isNotNull(), F.concat(F.lit("not billed on its own: "), F.lower("rule_title")))
        .otherwise("").alias("expected"),
        F.when(listed, amount).alias("impact_paise"),
    )


def apply_text_verdicts(lines: DataFrame, verdicts: DataFrame, rules: DataFrame, sources: DataFrame,
                        primary_source: str = "keyword") -> DataFrame:
    """Join verdicts back to all lines. The hottest description is spread over salts, see `salted_left_join`."""
    table = sized(enrich(verdicts, rules, sources))
    other = F.col("head") == "OTHER"
    keyed = lines.withColumn("text", F.when(other, F.lower("description")))
    judged = salted_left_join(keyed, table, "text", ["claim_id", "line_no"])
    return as_findings(judged.withColumns({
        "classification": F.when(other, F.col("classification")).otherwise("PAYABLE"),
        "reason": F.when(other, F.col("reason")).otherwise(F.concat(F.lit("Primary service, billed under head "), "head", F.lit("."))),
        "confidence": F.when(other, F.col("confidence")).otherwise(1.0),
        "source": F.when(other, F.col("source")).otherwise(primary_source),
    }))


def apply_model_verdicts(lines: DataFrame, verdicts: DataFrame, rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Verdicts of a model, as a table keyed (tenant, claim_id, line_no).

    A deduction without a citation of an existing rule is not trusted, and a line the model skipped is
    reported, never assumed payable.
    """
    proposed = verdicts.select(
        "tenant", "claim_id", "line_no", F.col("classification").alias("proposed"), F.col("cited_chunk_id").alias("claimed"),
        F.col("reason").alias("model_reason"), F.col("confidence").alias("model_confidence"))
    joined = lines.join(proposed, ["tenant", "claim_id", "line_no"], "left")
    judged = enrich(joined.withColumn("cited_chunk_id", F.col("claimed")), rules, sources)
    known = F.col("rule_title").isNotNull()
    answered, uncited = F.col("proposed").isNotNull(), is_listed(F.col("proposed")) & ~known
    drop = ~answered | uncited
    return as_findings(judged.withColumns({
        "classification": F.when(drop, "UNMAPPED").otherwise(F.col("proposed")),
        "cited_chunk_id": F.when(known & ~drop, F.col("claimed")),
        "reason": F.when(~answered, "The model gave no verdict for this line. Needs manual review.")
        .when(uncited, F.concat(F.lit("The model proposed "), "proposed", F.lit(" without citing an existing entry. Needs manual review.")))
        .otherwise(F.col("model_reason")),
        "confidence": F.when(drop, 0.0).otherwise(F.col("model_confidence")),
        "source": F.when(answered, "llm").otherwise("keyword"),
        **{c: F.when(known & ~drop, F.col(c)) for c in ("rule_bearer", "rule_severity", "rule_title", "source_id", "citation")},
    }))


def classify_items(lines: DataFrame, rules: DataFrame, sources: DataFrame, strategy: str = "auto", *,
                   vectors: tuple[DataFrame, DataFrame] | None = None,
                   scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Findings by name of strategy: auto, head_only, keyword, retrieval, deterministic or llm.

    `vectors` is (text -> vec, chunk_id -> vec). `scorer` turns lines into a verdict table that may
    carry an `error` column; under auto, a claim with an error falls back to deterministic as a whole.
    """
    texts = other_texts(lines)
    pair = vectors or (None, None)
    if strategy == "head_only":
        return apply_text_verdicts(lines, head_only_verdicts(texts), rules, sources)
    if strategy == "keyword":
        return apply_text_verdicts(lines, alias_verdicts(texts, rules), rules, sources)
    if strategy == "retrieval":
        return apply_text_verdicts(lines, retrieval_verdicts(sized(texts), rules, *pair), rules, sources, "retrieval")
    if strategy == "deterministic" or (strategy == "auto" and scorer is None):
        return apply_text_verdicts(lines, deterministic_verdicts(sized(texts), rules, *pair), rules, sources, "retrieval")
    if strategy not in ("auto", "llm"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if scorer is None:
        raise RuntimeError("strategy 'llm' needs a scorer")
    verdicts = scorer(lines)
    if strategy == "llm" or "error" not in verdicts.columns:
        return apply_model_verdicts(lines, verdicts.drop("error"), rules, sources)
    failed = verdicts.where(F.col("error").isNotNull()).select("tenant", "claim_id").distinct()
    keys = ["tenant", "claim_id"]
    good = apply_model_verdicts(lines.join(failed, keys, "left_anti"), verdicts.drop("error"), rules, sources)
    rest = lines.join(failed, keys, "left_semi")
    return good.unionByName(classify_items(rest, rules, sources, "deterministic", vectors=vectors))


def scorer_errors(verdicts: DataFrame) -> DataFrame:
    """One note per claim that fell back, so that a weaker result is never silent."""
    return verdicts.where(F.col("error").isNotNull()).groupBy("tenant", "claim_id").agg(
        F.concat(F.lit("classify: fell back to deterministic ("), F.min("error"), F.lit(")")).alias("error"))


def ai_used(findings: DataFrame) -> DataFrame:
    return findings.groupBy("tenant", "claim_id").agg(F.bool_or(F.col("source") == "llm").alias("ai_used"))
