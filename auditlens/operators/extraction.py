"""Bill rows from table cells: (doc_id, page, row_no, cells)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.functions import text as tx
from auditlens.functions.money import parse_amount, rate_per_day
from auditlens.functions.rows import MARK, evaluated, here

# --- fixed values: shape of a row and the accept threshold ---
MIN_CELLS, MIN_ITEMS = 6, 3
READ_CONFIDENCE = 0.7
# --- end of fixed values ---


def numbered(rows: DataFrame) -> DataFrame:
    """line_no in reading order. A document is bounded, so its rows meet in one sorted window, and the cells are read once."""
    order = Window.partitionBy("doc_id").orderBy("page", "row_no")
    return rows.withColumn("line_no", F.row_number().over(order).cast("bigint"))


def rows_to_items(cells: DataFrame) -> DataFrame:
    """Priced rows of ruled tables, numbered per document in reading order. Headers, totals and blanks drop out."""
    cell = lambda i: tx.strip(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    names = ("serial", "description", "department", "quantity_text", "rate_text", "amount_text")
    read = evaluated(cells.select("doc_id", "page", "row_no", F.size("cells").alias("n"), *[cell(i).alias(c) for i, c in enumerate(names)]))
    rows = read.where((F.col("n") >= MIN_CELLS) & F.col("serial").rlike(r"^\d+$") & (F.col("description") != "") & here())
    priced = evaluated(rows.drop(MARK).withColumn("amount", parse_amount(F.col("amount_text")))).where((F.col("amount") > 0) & here())
    items = priced.select(
        "doc_id", "page", "row_no", "description", tx.head_from_department(F.col("department")).alias("head"),
        parse_amount(F.col("quantity_text"), "1").alias("quantity"), parse_amount(F.col("rate_text")).alias("unit_rate"), "amount",
        "amount_text", F.lit(1.0).alias("extract_confidence"))
    return numbered(items)


def dedupe_rows(rows: DataFrame, drop_blank: bool = False) -> DataFrame:
    """First of equal (description, amount text) rows of a document, renumbered.

    Copies meet as one aggregate per key, so a row that is repeated without end stays one row per partition.
    """
    source = rows.where(tx.strip(F.col("description")) != "") if drop_blank else rows
    kept = [c for c in rows.columns if c not in ("doc_id", "page", "row_no", "line_no")]
    first = source.groupBy("doc_id", tx.item_key(F.col("description")).alias("_key"), F.col("amount_text").alias("_text")).agg(
        F.min_by(F.struct("page", "row_no", *kept), F.struct("page", "row_no")).alias("r"))
    return numbered(first.select("doc_id", "r.*"))


def room_stay_from_items(items: DataFrame) -> DataFrame:
    """The stay a bill describes: dearest room row (the first on a tie), days of all room rows.

    No room row, no rate or less than a day: no stay, rather than an invented one.
    """
    paise = lambda c: (F.col(c) * 100).cast("decimal(24,6)")
    rate = rate_per_day(paise("unit_rate"), F.col("quantity"), paise("amount"))
    rooms = items.where(F.col("head") == "ROOM").withColumn("_rate", rate)
    stays = rooms.groupBy("doc_id").agg(
        F.min_by(F.struct("description", "_rate"), F.struct(-F.col("_rate"), F.col("line_no"))).alias("d"),
        F.round(F.sum("quantity"), 0).cast("bigint").alias("days"))
    category = tx.strip(F.col("d.description"))
    return stays.where((F.col("d._rate") > 0) & (F.col("days") >= 1)).select(
        "doc_id", F.when(category == "", "Room").otherwise(category).alias("room_category"),
        F.col("d._rate").alias("rate_paise"), "days", tx.is_icu(category).alias("is_icu"))


def accepted_documents(items: DataFrame, minimum: int = MIN_ITEMS) -> DataFrame:
    """Documents whose tables gave enough rows to be taken without reading them another way."""
    return items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items")).where(F.col("n_items") >= minimum)


def extraction_summary(items: DataFrame, method: Column | str = "text_layer") -> DataFrame:
    return items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.bool_or(F.col("head") == "IMPLANT").alias("has_implant"),
        F.count(F.when(F.col("extract_confidence") < READ_CONFIDENCE, 1)).alias("low_confidence")).withColumn(
        "method", F.lit(method) if isinstance(method, str) else method)
