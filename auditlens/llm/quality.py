"""Quality rules whose thresholds follow the data: per language and source, from mergeable quantile sketches.

Measures are taken once per document with built-in functions. KLL sketches of every measure are built per (lang, source) from the
documents that pass the base rules, combined before the shuffle, and merged upwards to languages and to all documents. A group's
quantiles are drawn towards those of its language by how few rows it has, n / (n + WEIGHT), and a language's towards those of all
documents in the same way, so there is no size at which a group changes its judge. The fences are then joined to the measures.

Most documents have no symbols and no repeated lines at all, and the quantile of such a group is 0. Its documents then fall in two
classes, those without and those with: the fence is at least midway between none and a quantile of those with, from a second sketch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import SPACES, boxed, cut, one_per_id, words


@dataclass(frozen=True)
class Rule:
    """Accept `measure` = count / total up to top + reach * (top - mid), two quantiles of the group, or up to half the quantile `part` of its
    documents that have any, if that is more; with `low`, from mid - reach * (top - mid) too. `top` leaves out as many rows as junk may
    make up.

    A rate is known only as far as the document's size tells: counts come in steps of `unit`, so one step more is no difference, nor are
    DEVIATIONS times the deviation that a count has at the fence's rate in a document of its size.
    """

    measure: str
    count: str
    total: str
    mid: float = 0.5
    top: float = 0.95
    unit: int = 1
    reach: float = 3.0
    part: float | None = 0.5
    low: bool = False


RULES = (
    Rule("symbol_share", "n_symbols", "word_chars", top=0.8, part=0.25),
    Rule("dup_line_share", "n_dup_lines", "n_lines", top=0.8),
    Rule("repeat_share", "n_repeat_words", "n_words", unit=6, part=None),  # two times three words
    Rule("mean_word", "word_chars", "n_words", mid=0.25, top=0.75, part=None, low=True),
)
MIN_WORDS = 50
#: Rows of a group at which its own quantiles weigh as much as those of its language.
WEIGHT = 20.0
DEVIATIONS = 2.0


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and four shares.

    A NULL text has no words. Rows are measured one by one: repeated ids and further columns do not matter, but columns
    that bear the names of measures are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    made = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *(r.measure for r in RULES))
    rest = [c for c in docs.columns if c not in (text, *made)]
    split = docs.select(
        *rest, words(F.col(text)).alias("_words"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
    )
    n = F.size("_words")
    grams = split.select(
        *rest, "n_symbols", n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
            F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).alias("_grams"),
    )
    found = grams.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    twice = found.withColumn("_at", F.sort_array(F.transform(
        F.filter("_sorted", lambda x, i: same(x, F.get("_sorted", i - 1)) | same(x, F.get("_sorted", i + 1))), lambda x: x["i"])))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["sum"] + p + 3 - F.greatest(p, acc["end"])).alias("sum"), (p + 3).alias("end")),
        lambda acc: acc["sum"].cast("long"))
    counted = twice.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counted.select(
        *rest, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thresholds(measured: DataFrame, rules: tuple[Rule, ...] = RULES, weight: float = WEIGHT) -> DataFrame:
    """One row per (lang, source) with the fences `low_` and `high_` of every rule, from the rows that pass the base rules."""
    some = lambda r: F.when(F.col(r.measure) > 0, F.col(r.measure))
    groups = cut(measured.where(~base_failed()).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(r.measure).alias(r.measure) for r in rules],
        *[c for r in rules if r.part for c in (F.count(some(r)).alias(f"n_{r.measure}"), F.kll_sketch_agg_double(some(r)).alias(f"some_{r.measure}"))]))
    merged = lambda *keys: groups.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.kll_merge_agg_double(r.measure).alias(r.measure) for r in rules],
        *[c for r in rules if r.part for c in (F.sum(f"n_{r.measure}").alias(f"n_{r.measure}"), F.kll_merge_agg_double(f"some_{r.measure}").alias(f"some_{r.measure}"))])
    every, by_lang = merged(F.lit(1).alias("_all")), merged("lang")
    own, lang, top = _quantiles(groups, rules, "g"), _quantiles(by_lang, rules, "l"), _quantiles(every, rules, "a").drop("_all")
    bounds = own.join(lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    bounds = bounds.withColumn("_any", F.col("g_n") > 0).join(top.withColumn("_any", F.col("a_n") > 0), "_any", "left")

    def drawn(name: str, rows: str) -> Column:
        """A quantile of the group, drawn to its language's, which is drawn to that of all documents."""
        value = F.coalesce(F.col(f"a_{name}"), F.lit(0.0))
        for tag in ("l", "g"):
            n = F.col(f"{tag}_{rows}")
            value = (n * F.coalesce(F.col(f"{tag}_{name}"), value) + F.lit(weight) * value) / (n + F.lit(weight))
        return value

    out = []
    for r in rules:
        mid, high = drawn(f"mid_{r.measure}", "n"), drawn(f"top_{r.measure}", "n")
        fence = high + r.reach * (high - mid)
        out += [(mid - r.reach * (high - mid) if r.low else F.lit(None).cast("double")).alias(f"low_{r.measure}"),
                (F.greatest(fence, drawn(f"some_{r.measure}", f"n_{r.measure}") / 2) if r.part else fence).alias(f"high_{r.measure}")]
    return bounds.select("lang", "source", *out)


def _quantiles(sketches: DataFrame, rules: tuple[Rule, ...], tag: str) -> DataFrame:
    keys = [c for c in sketches.columns if c in ("lang", "source", "_all")]
    out = [F.col("n").alias(f"{tag}_n")]
    for r in rules:
        out += [F.kll_sketch_get_quantile_double(r.measure, F.lit(q)).alias(f"{tag}_{name}_{r.measure}") for name, q in (("mid", r.mid), ("top", r.top))]
        if r.part:
            some = F.when(F.col(f"n_{r.measure}") > 0, F.kll_sketch_get_quantile_double(f"some_{r.measure}", F.lit(r.part)))
            out += [F.col(f"n_{r.measure}").alias(f"{tag}_n_{r.measure}"), some.alias(f"{tag}_some_{r.measure}")]
    return sketches.select(*keys, *out)


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES, weight: float = WEIGHT) -> DataFrame:
    """Measured rows with `base_failed` and `kept`. NULL languages and sources are groups of their own."""
    rest = [c for c in measured.columns if c not in ("base_failed", "kept")]
    bounds = thresholds(measured, rules, weight).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.select(*rest).join(
        bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fine = F.lit(True)
    for r in rules:
        value, total = F.col(r.measure), F.col(r.total)
        slack = lambda fence: F.try_divide(F.lit(r.unit) + F.lit(DEVIATIONS) * F.sqrt(F.lit(r.unit) * F.greatest(fence, F.lit(0.0)) * total), total)  # noqa: B023, E731
        high, low = F.col(f"high_{r.measure}"), F.col(f"low_{r.measure}")
        fine &= F.coalesce(value <= high + slack(high), F.lit(True)) & F.coalesce(value >= low - slack(low), F.lit(True))
    return joined.select(*rest, base_failed().alias("base_failed"), (~base_failed() & fine).alias("kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document (needs doc_id, text, lang, source); measured once, then kept for both uses.

    An empty table gives no rows. A repeated row is measured and counted again and returned again.
    """
    keep = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    return judge(cut(measures(docs.select(*keep))))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is to keep them, all their columns as they were; rows that repeat an id are one document, with
    the greatest text."""
    docs = one_per_id(docs, "doc_id", "text")
    verdict = quality_verdicts(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return boxed(docs, "doc_id").join(verdict, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
