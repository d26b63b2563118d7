"""Text files that describe hypergraphs: link lists, tables of categories, and scenes with their characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.properties import distinct_rows
from ..graph import HGraph
from .collections import from_bipartite


def read_link_list(spark: SparkSession, path: str, separator: str = " ") -> HGraph:
    """A file with two ids a line as a bipartite graph: the first is the edge, the second the node."""
    rows = spark.read.csv(path, sep=separator, schema="src string, dst string")
    sides = rows.select(F.col("src").alias("id"), F.lit(0).alias("bipartite")).unionByName(rows.select(F.col("dst").alias("id"), F.lit(1).alias("bipartite"))).distinct()
    return from_bipartite(sides, rows)


def read_receivers_senders(spark: SparkSession, path: str) -> DataFrame:
    """receivers, senders of a file of comma-separated values without a header."""
    return spark.read.csv(path, schema="receivers string, senders string")


def code_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with nulls named `Unknown <column>`, and for each its code `<column>_code`: places of sorted values."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(f"Unknown {c}")))
        values = df.select(c).distinct()
        codes = values.withColumn(f"{c}_code", F.row_number().over(Window.orderBy(c)) - 1)  # the values of a category are few
        df = df.join(F.broadcast(codes), c)
    return df


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows over the columns and how many rows each has: the non-zero cells of their count tensor."""
    return distinct_rows(df.select(*columns), None, "count")


def with_random_weight(df: DataFrame, column: str = "weight", seed: int = 0) -> DataFrame:
    """df with uniform random weights from 0 to 1."""
    return df.withColumn(column, F.rand(seed))


def weight_by(df: DataFrame, key: str, weight: str = "weight") -> DataFrame | None:
    """uid, weight: weights summed by a column; None without weights."""
    return df.groupBy(F.col(key).alias("uid")).agg(F.sum(weight).alias("weight")) if weight in df.columns else None


def parse_scenes(lines: DataFrame, column: str = "value") -> DataFrame:
    """volume, book, chapter, scene, step, character of lines `v.b.c:A,B;C,D`: scenes are apart by semicolons, steps
    number all scenes in order, from 0."""
    place = F.split(F.split(column, ":")[0], r"\.")
    scenes = lines.filter(F.col(column).contains(":")).select(*(place[i].cast("int").alias(n) for i, n in enumerate(("volume", "book", "chapter"))), F.posexplode(F.split(F.split(column, ":")[1], ";")).alias("scene", "_cast"))
    steps = scenes.withColumn("step", F.dense_rank().over(Window.orderBy("volume", "book", "chapter", "scene")) - 1)  # as long as a book
    cast = steps.withColumn("character", F.explode(F.split("_cast", ","))).withColumn("character", F.trim("character"))
    return cast.filter(F.col("character") != "").select("volume", "book", "chapter", "scene", "step", "character")


def parse_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """symbol, full_name, description of lines `SY full name, description`."""
    pattern = r"^(\S+)\s+([^,]*)(?:,\s*(.*))?$"
    parts = [F.regexp_extract(column, pattern, i).alias(n) for i, n in ((1, "symbol"), (2, "full_name"), (3, "description"))]
    return lines.filter(F.col(column).rlike(pattern)).select(*parts)


def scene_graph(scenes: DataFrame, by: tuple[str, ...] = ("volume", "book", "chapter", "scene"), on: str = "character") -> HGraph:
    """Edges are the joined values of `by`, nodes those of `on`; cells weigh 1 / size, rounded to two places."""
    pairs = scenes.select(F.concat_ws(".", *by).alias("edge"), F.col(on).alias("node")).distinct()
    weight = F.round(1 / F.count("*").over(Window.partitionBy("edge")), 2)
    return HGraph.from_dataframe(pairs.withColumn("weight", weight), "edge", "node")
