"""Windowed metrics over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.operators.intake import LATENCY_EDGES, histogram_columns, unfold_histogram


def histogram_stream(observations: DataFrame, by: list[str], width: str = "1 minute", lateness: str = "10 minutes",
                     edges: tuple[float, ...] = LATENCY_EDGES) -> DataFrame:
    """(window, labels, edge, cumulative, sum, count, avg), one set per closed window."""
    sums = observations.withWatermark("ts", lateness).groupBy(F.window("ts", width), *by).agg(*histogram_columns(F.col("value"), edges))
    return unfold_histogram(sums, ["window", *by], edges)
