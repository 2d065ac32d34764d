"""Shared ground of the text operators: tables, the shared folder, words, ids."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the operators, fixed: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; an own one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("a cluster has to name its shared folder in spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, where a lost executor does not take them along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def one_per_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per id: of rows that repeat one, that with the largest `value` (a NULL is the smallest), then with the largest of
    the other columns in turn, as far as they have an order. NULL is an id too.

    Tables whose ids are unique, which a count over the id column alone tells, come back as they are.
    """
    repeated = df.groupBy(key).count().where("count > 1").limit(1).count()
    if not repeated:
        return df
    others = [c for c in df.columns if c not in (key, value)]
    ordered = [c for c, kind in df.dtypes if c in others and not re.search("map<|variant", kind)]
    best = df.groupBy(key).agg(F.max_by(F.struct(value, *others), F.struct(F.col(value).isNotNull(), F.col(value), *ordered)).alias("_row"))
    return best.select(key, "_row.*").select(*df.columns)


def boxed(df: DataFrame, *keys: str) -> DataFrame:
    """The keys, and the whole row as `row`: whatever its columns are called, they do not meet those that an operator makes."""
    return df.select(*keys, F.struct("*").alias("row"))


def words(text: Column) -> Column:
    """The words of a text in order; no words for a NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
