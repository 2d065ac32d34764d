"""Secret scan that links the parts of a credential: identifiers, secrets and endpoints within one scope.

Strong parts are found by their form alone. Weak parts (a client id, a token of mixed letters, an address) are reported only
where a complementary part lies in the same paragraph, however long that is. The interval join of parts and paragraphs is a sweep: parts are
sorted by position within their document, running maxima carry the nearest earlier and later part of every role, and so work
and rows stay linear however many parts a scope holds. Positions come from the lengths of the gaps and matches in turn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.common import boxed, one_per_id


@dataclass(frozen=True)
class Part:
    """A pattern; `group`'s text needs `least` code points. A weak part needs another one of a role in `needs`, of each."""

    kind: str
    role: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which equal starts are listed. Base kinds first.
PARTS = (
    Part("assign", "secret", ASSIGN, 2, 6),
    Part("access", "id", r"AKIA[A-Z0-9]{16,}"),  # as AKIA[A-Z0-9]+ of 20 characters or more
    Part("hex", "secret", r"[0-9a-f]{24,}"),  # as [0-9a-f]+ of 24 characters or more
    Part("weak_id", "id", r"""(?i)\b(client_?id|access_?key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""", needs=("secret",)),
    Part("weak_key", "secret", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40,}={0,2}", needs=("id",)),
    Part("endpoint", "endpoint", r"""(?i)\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""", needs=("id", "secret")),
)
BASE = ("assign", "access", "hex")
ROLES = ("id", "secret", "endpoint")
MARK = "[SECRET]"


def _found(body: Column, k: int, part: Part) -> Column:
    """Matches of a part as structs (k, i, gap, len, size): the gap before the match, its length, and that of its group."""
    pattern = F.lit(part.pattern)
    gaps = F.transform(F.split(body, part.pattern, -1), F.length)
    lens = F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), F.length)
    sizes = F.transform(F.regexp_extract_all(body, pattern, F.lit(part.group)), F.length) if part.group else lens
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), lens.alias("len"), sizes.alias("size")),
        lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["size"].alias("size")))
    return F.when(body.rlike(part.pattern), rows)


def secret_spans(docs: DataFrame, parts: tuple[Part, ...] = PARTS) -> DataFrame:
    """Rows (doc_id, kind, k, start, end) in code points, end exclusive.

    A NULL or empty text has none; rows that repeat an id are read as one document, with the greatest text. Further columns
    are not looked at. Weak parts that overlap a strong one are that one.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    source = one_per_id(docs.select("doc_id", "text"), "doc_id", "text").select("doc_id", body.alias("_body"))
    none = F.array().cast("array<struct<k:int,i:int,gap:int,len:int,size:int>>")
    breaks = Part("", "", r"\n[\x20\x09\x0D]*\n")
    every = [*enumerate(parts), (-1, breaks)]
    text = F.col("_body")
    weak_only = F.lit(False)
    for p in parts:
        weak_only |= text.rlike(p.pattern)
    rows = source.where(weak_only).select("doc_id", F.explode(F.concat(
        *[F.coalesce(_found(text, k, p), none) for k, p in every])).alias("x")).select("doc_id", "x.*")
    rows = rows.repartition("doc_id")
    order = Window.partitionBy("doc_id", "k").orderBy("i")
    placed = rows.withColumn("_upto", F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(order)).where("len is not null")
    placed = placed.withColumn("start", (F.col("_upto") - F.col("len")).cast("int")).withColumn("end", F.col("_upto").cast("int"))
    least = F.create_map(*[F.lit(v) for k, p in every for v in (k, p.least)])
    placed = placed.where(F.col("size") >= F.element_at(least, F.col("k"))).select("doc_id", "k", "start", "end")
    return _linked(placed, parts)


def _linked(placed: DataFrame, parts: tuple[Part, ...]) -> DataFrame:
    strong = [k for k, p in enumerate(parts) if not p.needs]
    of = {role: [k for k, p in enumerate(parts) if p.role == role] for role in ROLES}
    ahead = Window.partitionBy("doc_id").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy(F.desc("start"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    is_k = lambda ks: F.col("k").isin(*ks)
    swept = placed
    for name, ks in [*of.items(), ("strong", strong), ("break", [-1])]:
        swept = swept.withColumn(f"_{name}_end", F.max(F.when(is_k(ks), F.col("end"))).over(ahead))
    for name, ks in [*of.items(), ("strong", strong), ("break", [-1])]:
        swept = swept.withColumn(f"_{name}_start", F.min(F.when(is_k(ks), F.col("start"))).over(after))
    before = lambda role: F.col(f"_{role}_end").isNotNull() & (
        F.col("_break_end").isNull() | (F.col("_break_end") <= F.col(f"_{role}_end")))
    behind = lambda role: F.col(f"_{role}_start").isNotNull() & (
        F.col("_break_start").isNull() | (F.col("_break_start") >= F.col(f"_{role}_start")))
    beside = lambda role: before(role) | behind(role)
    clash = F.coalesce(F.col("_strong_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_strong_start") < F.col("end"), F.lit(False))
    keep = is_k(strong)
    for k, p in enumerate(parts):
        if p.needs:
            linked = F.lit(True)
            for role in p.needs:
                linked &= beside(role)
            keep |= (F.col("k") == k) & linked & ~clash
    names = F.array(*[F.lit(p.kind) for p in parts])
    return swept.where(F.col("k") >= 0).where(keep).select("doc_id", F.get(names, F.col("k")).alias("kind"), "k", "start", "end")


def span_digests(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, a digest of the base spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    span = F.struct("start", "k", "end", "kind")
    base = F.col("kind").isin(*BASE)
    found = secret_spans(docs).groupBy("doc_id").agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}") for kind in BASE],
        F.collect_list(F.when(base, span)).alias("_base"), F.collect_list(span).alias("_all"))
    found = found.select(F.col("doc_id").alias("_id"), *[f"n_{kind}" for kind in BASE], listed(F.col("_base")).alias("_base"),
                         listed(F.col("_all")).alias("_all"))
    ids = one_per_id(docs.select("doc_id", "text"), "doc_id", "text").select("doc_id")
    joined = ids.join(found, ids.doc_id.eqNullSafe(found["_id"]), "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("_all", F.lit("")).alias("spans"))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """The documents with every found span replaced by `mark` (touching or overlapping spans by one) and n_chars, where
    there is such a column, counted anew in changed texts. All other columns stay; documents without secrets stay as they are. Rows that repeat an id are
    one document, with the greatest text."""
    docs = one_per_id(docs, "doc_id", "text")
    earlier = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    runs = (secret_spans(docs)
            .withColumn("_new", (F.col("start") > F.coalesce(F.max("end").over(earlier), F.lit(-1))).cast("int"))
            .withColumn("_run", F.sum("_new").over(upto)).groupBy("doc_id", "_run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end")))
    marks = runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut"))
    marks = marks.withColumnRenamed("doc_id", "cut_id")
    joined = boxed(docs, "doc_id", "text").join(marks, F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
    pieces = F.transform(F.sequence(F.lit(0), F.size("cut")), lambda i: F.substring(
        "text", F.coalesce(F.get("cut", i - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get("cut", i)["start"], F.length("text")) - F.coalesce(F.get("cut", i - 1)["end"], F.lit(0))))
    out = joined.select("row", "cut", F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(pieces, mark)).alias("left"))
    held = lambda c: F.col("row").getField(c)
    return out.select(*[
        F.col("left").alias("text") if c == "text"
        else F.when(F.col("cut").isNull(), held(c)).otherwise(F.length("left")).cast(t).alias(c) if c == "n_chars"
        else held(c).alias(c) for c, t in docs.dtypes])
