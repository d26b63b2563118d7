"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A key with more than this part of all rows is hot; there are fewer hot keys than this.
HOT_PART, LEAST_HOT = 2000, 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """The text with A-Z, and no other letters, in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def join_counted(rows: DataFrame, known: DataFrame, on: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with known, which has one row for each value of `on`, and in n how many of the total rows have it.

    Values of more than a HOT_PART-th of the rows are sent to all tasks (there are fewer than HOT_PART of them); rows of
    all other values are shuffled. Null values find nothing. known is read twice, so it should be written first.
    """
    bound = max(total // HOT_PART, LEAST_HOT)
    hot = F.broadcast(known.filter(F.col("n") > bound).drop("n"))
    rest = known.filter(F.col("n") <= bound).drop("n")
    few = rows if how == "inner" else rows.join(F.broadcast(known.filter(F.col("n") > bound).select(on)), on, "left_anti")
    return rows.join(hot, on).unionByName(few.join(rest, on, how))
