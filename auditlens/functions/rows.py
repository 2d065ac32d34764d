"""Row-level helpers: small constant tables, joins that spread hot keys, top rows per group."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 16


def constant_rows(spark: SparkSession, schema: str, rows: Iterable[Sequence[Any]]) -> DataFrame:
    """A fixed table known when the plan is written (never data)."""
    names = [f.split()[0] for f in _split_ddl(schema)]
    types = [f.split(None, 1)[1] for f in _split_ddl(schema)]
    structs = [
        F.struct(*[_literal(v).cast(t).alias(n) for v, n, t in zip(row, names, types)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _literal(v: Any) -> Column:
    if isinstance(v, (list, tuple)):
        return F.array(*[_literal(x) for x in v])
    return F.lit(v)


def _split_ddl(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += ch in "<(" 
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            parts.append(schema[start:i].strip())
            start = i + 1
    return parts + [schema[start:].strip()]


def sized(df: DataFrame) -> DataFrame:
    """Compute a reduced side once and keep it, so that the planner knows its true size.

    A later join broadcasts it only when that size is under Spark's own threshold; otherwise
    the join shuffles. Lost blocks are recomputed from lineage.
    """
    kept = df.persist()
    kept.count()
    _held().append(kept)
    return kept


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt out by `keys`, about `rows` rows to a task; few rows stay where they are.

    For rows of few bytes that take much work: a reader cuts a table by its bytes, and leaves such work to one task.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts, *keys) if parts > 1 else df


_LOCAL = threading.local()


def _held() -> list[DataFrame]:
    if not hasattr(_LOCAL, "frames"):
        _LOCAL.frames = []
    return _LOCAL.frames


@contextmanager
def releasing() -> Iterator[None]:
    """Drop what `sized` has kept inside the block. For callers that run again and again, such as a stream."""
    start = len(_held())
    try:
        yield
    finally:
        for df in _held()[start:]:
            df.unpersist()
        del _held()[start:]


MARK = "_mark"


def evaluated(df: DataFrame) -> DataFrame:
    """Rows with a mark that keeps a later filter above the expressions of `df`.

    A filter on computed columns is pushed below them with every expression written out again, once per use.
    Filter on `here()` as well, and the expressions run once per row.
    """
    return df.withColumn(MARK, F.monotonically_increasing_id())


def here() -> Column:
    return F.col(MARK) >= 0


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str],
                     how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join on `key` where few keys may hold most of the left rows.

    `right` has to hold one row per key (or few) and is repeated once per salt; the left rows of a hot
    key, and those with a NULL key, spread over the salts.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  name: str = "rank") -> DataFrame:
    """First k rows of every group. Spark prunes each partition to k rows before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
