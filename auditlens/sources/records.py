"""Run traces, labelled sets and document texts: JSON documents with nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: schemas ---
TRACE = (
    "claim_id string, tenant string, nodes array<struct<node: string, started_at: string, latency_ms: bigint, prompt_tokens: bigint, "
    "completion_tokens: bigint, llm_calls: bigint, cache_hits: bigint, attempts: bigint, note: string, error: string>>"
)
LABELLED_ITEMS = "items array<struct<description: string, head: string, expected: string>>"
LABELLED_QUERIES = "queries array<struct<query: string, expected: array<string>>>"
# --- end of fixed values ---


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def unreadable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, key, text) of files that are not whole documents of `schema`, with its first field as far as that could be read."""
    first = schema.split()[0]
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is not null").select(
        F.col("_metadata.file_name").alias("file"), F.col(first).cast("string").alias("key"), F.col("_corrupt").alias("text"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, TRACE).withColumn("written_at", F.col("_metadata.file_modification_time"))


def parse_traces(texts: DataFrame, column: str = "json") -> DataFrame:
    rest = [c for c in texts.columns if c != column]
    return texts.select(*rest, F.from_json(column, TRACE).alias("t")).select(*rest, "t.*")


def trace_nodes(traces: DataFrame) -> DataFrame:
    """One row per node of a run; counters that are missing count as 0, the tenant defaults to 'local'."""
    rows = traces.where("claim_id is not null").select("claim_id", F.coalesce("tenant", F.lit("local")).alias("tenant"), F.posexplode("nodes").alias("node_no", "n"))
    numbers = ("latency_ms", "prompt_tokens", "completion_tokens", "llm_calls", "cache_hits")
    return rows.select(
        "tenant", "claim_id", "node_no", "n.node", "n.started_at", *[F.coalesce(F.col(f"n.{c}"), F.lit(0)).alias(c) for c in numbers],
        F.coalesce("n.attempts", F.lit(1)).alias("attempts"), F.coalesce("n.note", F.lit("")).alias("note"), F.coalesce("n.error", F.lit("")).alias("error"))


def read_labelled_items(spark: SparkSession, path: str) -> DataFrame:
    return labelled_items(_json(spark, path, LABELLED_ITEMS))


def read_labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    return labelled_queries(_json(spark, path, LABELLED_QUERIES))


def labelled_items(files: DataFrame) -> DataFrame:
    rest = [c for c in files.columns if c != "items"]
    return files.select(*rest, F.posexplode("items").alias("pos", "i")).select(*rest, (F.col("pos") + 1).alias("line_no"), "i.*")


def labelled_queries(files: DataFrame) -> DataFrame:
    rest = [c for c in files.columns if c != "queries"]
    return files.select(*rest, F.posexplode("queries").alias("pos", "q")).select(*rest, "pos", "q.query", "q.expected")


def read_document_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of text files, one document per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
