"""Rule catalogue: markdown files with rule blocks, and the registry of their sources.

Parsing works on a table (path, text), one row per file, so it is the same for a directory on
shared storage and for the catalogue packaged with the library.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.rows import constant_rows
from auditlens.functions.vocabulary import CLASSES, SEVERITIES

# --- fixed values: the file format ---
FILE_BLOCK = r"(?s)<!--\s*source:\s*(.*?)-->"
RULE_HEADER = r"<!--\s*chunk_id:\s*([\w\-.]+)\s*((?:\|[^|>]+)*)-->"
TITLE = r"(?m)^#{1,6}\s*(.+)$"
ALIASES = r"(?m)^Aliases:\s*(.+)$"
REQUIRED = ("jurisdiction", "severity", "source_id", "citation", "citation_precision")
PRECISIONS = ("item", "list")
STATUSES = ("in_force", "superseded", "unverified")
# --- end of fixed values ---


def read_rule_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, text) of every markdown file below a directory all executors can read."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
        .text(directory, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def packaged_rule_files(spark: SparkSession) -> DataFrame:
    files = resources.files("auditlens.catalog")
    rows = [(f.name, f.read_text(encoding="utf-8")) for f in files.iterdir() if f.name.endswith(".md")]
    return constant_rows(spark, "path string, text string", sorted(rows))


def key_values(block: Column) -> Column:
    """`key: value` pairs separated by newlines or pipes, as a map; a repeated key keeps its last value."""
    entries = F.transform(
        F.filter(F.split(block, r"[|\n]"), lambda p: p.contains(":")),
        lambda p: F.struct(
            tx.strip(F.substring_index(p, ":", 1)).alias("k"),
            tx.strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("v"),
        ),
    )

    def last(pairs: Column) -> Column:
        return F.filter(pairs, lambda p, i: (p["k"] != "") & ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))

    # The pairs are bound to a name first: a lambda that holds their expression works them out again for every pair.
    return F.map_from_entries(F.element_at(F.transform(F.array(entries), last), 1))


def rule_blocks(files: DataFrame) -> DataFrame:
    """One row per rule block, metadata of the header winning over that of its file."""
    headers = F.regexp_extract_all("text", F.lit(f"({RULE_HEADER})"), 1)
    pieces = files.select(
        "path",
        F.when(F.col("text").rlike(FILE_BLOCK), key_values(F.regexp_extract("text", FILE_BLOCK, 1))).alias("defaults"),
        headers.alias("headers"),
        F.slice(F.split("text", RULE_HEADER), F.lit(2), F.size(headers)).alias("blocks"),
    )
    rows = pieces.select("path", "defaults", F.posexplode(F.arrays_zip("headers", "blocks")).alias("pos", "r"))
    header, block = F.col("r.headers"), tx.strip(F.col("r.blocks"))
    return rows.select(
        "path", "pos", "defaults",
        F.regexp_extract(header, RULE_HEADER, 1).alias("chunk_id"),
        key_values(F.regexp_extract(header, RULE_HEADER, 2)).alias("own"),
        block.alias("block"),
    )


def parse_rules(files: DataFrame) -> DataFrame:
    """Rules with attribution. Ordered by (path, pos); invalid ones are still in it, see `rule_violations`."""
    block = F.col("block")
    title_line = F.regexp_extract(block, TITLE, 0)
    alias_line = F.regexp_extract(block, ALIASES, 0)
    rest = F.replace(F.replace(block, F.nullif(title_line, F.lit("")), F.lit("")), F.nullif(alias_line, F.lit("")), F.lit(""))
    body = F.when((title_line != "") & (alias_line != ""), rest).when(
        title_line != "", F.replace(block, title_line, F.lit(""))).when(
        alias_line != "", F.replace(block, alias_line, F.lit(""))).otherwise(block)
    aliases = F.filter(
        F.transform(F.split(F.regexp_extract(block, ALIASES, 1), ","), tx.strip), lambda a: a != "")

    def meta(key: str) -> Column:
        return F.coalesce(F.try_element_at("own", F.lit(key)), F.try_element_at("defaults", F.lit(key)))

    return rule_blocks(files).select(
        "path", "pos", "chunk_id",
        F.when(title_line != "", tx.strip(F.regexp_extract(block, TITLE, 1))).otherwise(F.col("chunk_id")).alias("title"),
        aliases.alias("aliases"),
        tx.strip(F.regexp_replace(body, r"\s+", " ")).alias("body"),
        F.col("defaults").isNotNull().alias("has_source_block"),
        *[meta(k).alias(k) for k in REQUIRED],
        meta("list").alias("list_name"), meta("bearer").alias("bearer"), meta("topic").alias("topic"),
    )


def rule_violations(rules: DataFrame, sources: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, chunk_id, problem) for everything that makes a catalogue unusable; empty when it is sound."""
    def bad(cond: Column, problem: str) -> Column:
        return F.when(cond, F.lit(problem))

    per_rule = rules.select("path", "chunk_id", F.explode(F.array_compact(F.array(
        bad(~F.col("has_source_block"), "file has no source block"),
        *[bad(F.col("has_source_block") & (F.coalesce(F.col(k), F.lit("")) == ""), f"missing {k}") for k in REQUIRED],
        bad((F.col("severity") != "") & ~F.col("severity").isin(*SEVERITIES), "unknown severity"),
        bad((F.col("citation_precision") != "") & ~F.col("citation_precision").isin(*PRECISIONS), "unknown citation_precision"),
        bad(F.col("list_name").isNotNull() & ~F.col("list_name").isin(*[c for c in CLASSES if c.startswith("LIST_")]), "unknown list"),
    ))).alias("problem"))
    twice = (
        rules.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
        .where("n > 1").select("path", "chunk_id", F.lit("duplicate chunk_id").alias("problem"))
    )
    unknown = (
        rules.where(F.coalesce(F.col("source_id"), F.lit("")) != "")
        .join(sources.select("source_id"), "source_id", "left_anti")
        .select("path", "chunk_id", F.lit("unknown source_id").alias("problem"))
    )
    found = per_rule.unionByName(twice).unionByName(unknown)
    if files is not None:
        found = found.unionByName(
            files.where(~F.col("text").rlike(FILE_BLOCK))
            .select("path", F.lit(None).cast("string").alias("chunk_id"), F.lit("file has no source block").alias("problem"))
        ).distinct()
    return found


def load_rules(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Parsed rules, or an error naming the first problems: a half-read catalogue is never served."""
    rules = parse_rules(files)
    problems = rule_violations(rules, sources, files).orderBy("path", "chunk_id", "problem").take(10)
    if problems:
        raise ValueError("rule catalogue refused: " + "; ".join(f"{p.path} {p.chunk_id}: {p.problem}" for p in problems))
    if rules.isEmpty():
        raise ValueError("rule catalogue refused: no rules found")
    return rules


# --- registry of sources -------------------------------------------------

_SOURCE_TEXT = ("source_id", "jurisdiction", "title", "reference", "publisher", "url", "superseded_by", "status", "note")
_SOURCE_DATE = ("published", "retrieved", "verified_on")


def read_source_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def packaged_source_files(spark: SparkSession) -> DataFrame:
    f = resources.files("auditlens.catalog") / "sources.toml"
    return constant_rows(spark, "path string, text string", [(f.name, f.read_text(encoding="utf-8"))])


def parse_sources(files: DataFrame) -> DataFrame:
    """One row per `[[source]]` entry: quoted strings, triple-quoted notes and bare dates."""
    parts = F.split("text", r"(?m)^\[\[source\]\]\s*$")
    entries = files.select("path", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "entry"))

    def text_of(key: str) -> Column:
        short = F.regexp_extract("entry", rf'(?m)^{key}\s*=\s*"([^"\n]*)"\s*$', 1)
        if key != "note":
            return F.when(F.col("entry").rlike(rf'(?m)^{key}\s*=\s*"'), short)
        long = F.regexp_extract("entry", rf'(?ms)^{key}\s*=\s*"""\n?(.*?)"""', 1)
        return F.when(F.col("entry").rlike(rf'(?m)^{key}\s*=\s*"""'), long).when(
            F.col("entry").rlike(rf'(?m)^{key}\s*=\s*"'), short)

    def date_of(key: str) -> Column:
        return F.nullif(F.regexp_extract("entry", rf"(?m)^{key}\s*=\s*(\d{{4}}-\d\d-\d\d)", 1), F.lit("")).cast("date")

    rows = entries.select(
        "path", "pos",
        *[text_of(k).alias(k) for k in _SOURCE_TEXT], *[date_of(k).alias(k) for k in _SOURCE_DATE],
    )
    return (
        rows.withColumn("status", F.coalesce("status", F.lit("unverified")))
        .withColumn("reference", F.coalesce("reference", F.lit("")))
    )


def source_violations(sources: DataFrame) -> DataFrame:
    blank = lambda k: F.col(k).isNull() | (F.col(k).cast("string") == "")
    return sources.select("path", "pos", F.explode(F.array_compact(F.array(
        *[F.when(blank(k), F.lit(f"missing {k}")) for k in ("source_id", "jurisdiction", "title", "published", "retrieved")],
        F.when(~F.col("status").isin(*STATUSES), F.lit("unknown status")),
    ))).alias("problem"))


def catalogue(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(rules, sources) packaged with the library."""
    return parse_rules(packaged_rule_files(spark)), parse_sources(packaged_source_files(spark))
