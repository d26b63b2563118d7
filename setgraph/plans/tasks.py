"""Numbers of tasks that grow with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task groups.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df, of about n rows, dealt by its keys over enough tasks, if a shuffle of the session has fewer."""
    tasks = -(-n // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
