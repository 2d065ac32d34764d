"""Scores against labels. All rates are exact ratios, rounded half-even once."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.money import ratio
from auditlens.functions.rows import top_per_group
from auditlens.functions.vocabulary import is_listed

DIGITS = 4


def _rate(hit: str, base: str, empty: int) -> Column:
    return F.coalesce(ratio(F.col(hit), F.col(base), DIGITS), F.lit(Decimal(empty)).cast(f"decimal(22,{DIGITS})"))


def score_classification(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """judged: expected, got, cited_chunk_id (and the columns of `by`). One row per group."""
    expected, got = F.col("expected"), F.col("got")
    n = lambda cond: F.count(F.when(cond, 1))
    sums = judged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), n(expected == got).alias("correct"),
        n(expected != "PAYABLE").alias("non_payable"), n((expected != "PAYABLE") & (expected == got)).alias("non_payable_hit"),
        n(expected == "PAYABLE").alias("payable"), n((expected == "PAYABLE") & is_listed(got)).alias("wrongly_deducted"),
        n(is_listed(got)).alias("listed"), n(is_listed(got) & (F.coalesce("cited_chunk_id", F.lit("")) != "")).alias("cited"))
    return sums.select(
        *(by or []), "n", _rate("correct", "n", 0).alias("accuracy"), _rate("non_payable_hit", "non_payable", 0).alias("non_payable_recall"),
        _rate("wrongly_deducted", "payable", 0).alias("false_deduction_rate"), _rate("cited", "listed", 1).alias("citation_rate"))


def confusion(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    return judged.where(F.col("expected") != F.col("got")).groupBy(*(by or []), "expected", "got").agg(F.count(F.lit(1)).alias("n"))


def hit_flags(hits: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per query and strategy: was any expected document among the first k? expected: (query_id, doc_id)."""
    good = hits.join(expected.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    best = good.groupBy("query_id", "strategy").agg(F.min("rank").alias("best"))
    grid = expected.select("query_id").distinct().withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in ("bm25", "dense", "rrf")])))
    return grid.join(best, ["query_id", "strategy"], "left").select(
        "query_id", "strategy", *[F.coalesce(F.col("best") <= k, F.lit(False)).alias(f"hit_{k}") for k in ks])


def recall_at_k(flags: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    sums = flags.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(f"hit_{k}"), 1)).alias(f"h{k}") for k in ks])
    return sums.select("strategy", "n", *[_rate(f"h{k}", "n", 0).alias(f"recall_{k}") for k in ks])


def fusion_delta(recall: DataFrame) -> DataFrame:
    """What fusion gains at 5 over the better single strategy."""
    at = lambda s: F.max(F.when(F.col("strategy") == s, F.col("recall_5")))
    return recall.agg((at("rrf") - F.greatest(at("bm25"), at("dense"))).alias("delta"))


def misses(flags: DataFrame) -> DataFrame:
    return flags.where(~F.col("hit_5")).select("query_id", "strategy")


def compare_extraction(truth: DataFrame, extracted: DataFrame, key: list[str], listed: int = 6) -> DataFrame:
    """Per document: rows expected, extracted, matched, the accuracies over matches, totals, and what differs.

    Rows meet by normalised description; of several with the same text the last line counts.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(*key, tx.normalise_text(F.col("description")).alias("_d")).agg(
            F.max_by(F.struct("amount_paise", "head"), "line_no").alias(p), F.sum("amount_paise").cast("bigint").alias(f"{p}_total"))

    t, e = F.col("t"), F.col("e")
    both = t.isNotNull() & e.isNotNull()
    n = lambda cond: F.count(F.when(cond, 1))
    rows = side(truth, "t").join(side(extracted, "e"), [*key, "_d"], "full_outer")
    sums = rows.groupBy(*key).agg(
        n(t.isNotNull()).alias("rows_expected"), n(e.isNotNull()).alias("rows_extracted"), n(both).alias("rows_matched"),
        n(both & (t["amount_paise"] == e["amount_paise"])).alias("amount_ok"), n(both & (t["head"] == e["head"])).alias("head_ok"),
        F.coalesce(F.sum("t_total"), F.lit(0)).cast("bigint").alias("total_expected"), F.coalesce(F.sum("e_total"), F.lit(0)).cast("bigint").alias("total_got"))

    def some(df: DataFrame, name: str) -> DataFrame:
        return top_per_group(df, key, [F.asc("_d")], listed).groupBy(*key).agg(F.array_sort(F.collect_list("_d")).alias(name))

    empty = F.array().cast("array<string>")
    return (
        sums.join(some(rows.where(e.isNull()), "missed"), key, "left").join(some(rows.where(t.isNull()), "hallucinated"), key, "left")
        .select(*key, "rows_expected", "rows_extracted", "rows_matched", _rate("rows_matched", "rows_expected", 0).alias("row_recall"),
                _rate("amount_ok", "rows_matched", 0).alias("amount_accuracy"), _rate("head_ok", "rows_matched", 0).alias("head_accuracy"),
                "total_expected", "total_got", (F.col("total_expected") == F.col("total_got")).alias("total_exact"),
                F.coalesce("missed", empty).alias("missed"), F.coalesce("hallucinated", empty).alias("hallucinated"))
    )


def eval_aggregate(runs: DataFrame) -> DataFrame:
    """Means over audited samples. Judge scores average over judged runs only."""
    n = lambda cond: F.count(F.when(cond, 1))
    mean = lambda c, by="n": F.coalesce(ratio(F.col(c), F.col(by), DIGITS), F.lit(None).cast(f"decimal(22,{DIGITS})"))
    sums = runs.agg(
        F.count(F.lit(1)).alias("n"), n(F.col("invariant")).alias("inv"), n(F.col("verify_passed")).alias("ver"),
        F.sum("cited").alias("cited"), F.sum("listed").alias("listed"), F.sum("repairs").alias("rep"), F.sum("latency_ms").alias("lat"),
        F.sum("tokens").alias("tok"), F.count("groundedness").alias("judged"), F.sum("groundedness").alias("gr"), F.sum("usefulness").alias("us"))
    return sums.select(
        "n", mean("inv").alias("invariant_rate"), mean("ver").alias("verify_rate"), _rate("cited", "listed", 1).alias("citation_coverage"),
        mean("rep").alias("mean_repairs"), mean("lat").alias("mean_latency_ms"), mean("tok").alias("mean_tokens"), "judged",
        mean("gr", "judged").alias("groundedness"), mean("us", "judged").alias("usefulness"))


def threshold_sweep(scored: DataFrame, gates: tuple[Decimal, ...]) -> DataFrame:
    """scored: expected, list_name, chunk_id, cosine per line. The scores at every gate, in one pass."""
    table = F.array(*[F.lit(g).cast("decimal(4,2)") for g in gates])
    over = F.coalesce(F.col("cosine") >= F.col("gate").cast("double"), F.lit(False))
    judged = scored.withColumn("gate", F.explode(table)).withColumns({
        "got": F.when(over, F.col("list_name")).otherwise("PAYABLE"), "cited_chunk_id": F.when(over, F.col("chunk_id"))})
    return score_classification(judged, ["gate"])
