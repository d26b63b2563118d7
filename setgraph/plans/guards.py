"""Size checks before data leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

from ..errors import TooLargeError


def bounded_rows(df: DataFrame, most: int, what: str) -> list[Row]:
    """All rows of df on the driver; raises where there are more than `most`. Reads at most one row more."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooLargeError(f"{what}: more than {most} rows")
    return rows
