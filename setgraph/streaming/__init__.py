"""Statistics of hypergraphs whose incidences arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_seen(incidences: DataFrame, event_time: str, lateness: str) -> DataFrame:
    """Each pair once within the lateness allowed; state is dropped as the watermark passes."""
    return incidences.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["edge", "node"])


def windowed_sizes(incidences: DataFrame, event_time: str, window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes", level: str = "edge") -> DataFrame:
    """window, edge (or node), size: distinct pairs by time window, tumbling or sliding; late rows count as long as
    the watermark allows."""
    seen = _first_seen(incidences, event_time, lateness)
    return seen.groupBy(F.window(event_time, window, slide), level).agg(F.count("*").alias("size" if level == "edge" else "degree"))


def running_sizes(incidences: DataFrame, level: str = "edge") -> DataFrame:
    """edge (or node) and the approximate number of distinct opposite ids so far; state is one sketch an id."""
    other = "node" if level == "edge" else "edge"
    return incidences.groupBy(level).agg(F.approx_count_distinct(other, 0.02).alias("size" if level == "edge" else "degree"))
