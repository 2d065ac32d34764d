"""Main text of web pages: blocks of each page, labelled by the recurrent labeller, joined in page order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.html_blocks import blocks_of, features
from auditlens.llm.html_training import load
from auditlens.llm.labeller import scores
from auditlens.llm.vectors import chunks

#: Pages whose blocks are labelled together: so many bytes of html at a time, a larger page alone.
CHUNK_BYTES = 1 << 20


def main_text(pages: DataFrame, model: dict[str, np.ndarray] | None = None, threshold: float = 0.5) -> DataFrame:
    """Rows (page_id, url, text), one per page.

    A NULL or empty html gives an empty text, as does a page without main blocks. Repeated rows are extracted each. Further
    columns are not looked at. A page is labelled from its whole html; the model's weights are a fixed small table.
    """
    model = model or load()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch, "html", CHUNK_BYTES):
                found = [blocks_of(h.decode("utf-8", "replace")) for h in part]
                marks = scores(model, features(found))
                texts = [" ".join(b[0] for b, s in zip(blocks, mark) if s > threshold) for blocks, mark in zip(found, marks)]
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds['page_id']}, url string, text string")


def with_length(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("n_chars", F.length("text").cast("long"))
