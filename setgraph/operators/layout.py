"""The computations behind drawings that are about the graph, not about ink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SetGraphError
from ..graph import EDGES, NODES, HGraph
from ..plans.lineage import cut_lineage
from .pairs import containment
from .transforms import equivalence_classes


def collapsed_size(uid: Column) -> Column:
    """The count at the end of an id `uid:count`, 1 for other ids."""
    return F.coalesce(F.nullif(F.regexp_extract(uid.cast("string"), r":(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))


def create_labels(graph: HGraph, edges: bool = True, with_counts: bool = True, include_singletons: bool = False, as_set: bool = False) -> DataFrame:
    """rep, label of classes of identical edges (or nodes): the representative with its count, or all members."""
    classes = equivalence_classes(graph, edges)
    n = F.size("members")
    name = F.concat(F.lit("{"), F.array_join(F.transform("members", lambda x: x.cast("string")), ", "), F.lit("}")) if as_set else F.col("rep").cast("string")
    counted = F.when((n > 1) | F.lit(include_singletons), F.concat(name, F.lit(" x "), n)).otherwise(name) if with_counts else name
    return classes.select("rep", counted.alias("label"))


def set_layering(graph: HGraph, collapse: bool = True, most_rounds: int = 10_000) -> DataFrame:
    """edge, level: the length of the longest chain of edges within an edge."""
    links = containment(graph, collapse).persist()
    vertices = links.select(F.explode(F.array("src", "dst")).alias("edge")).distinct()
    if collapse:
        from .transforms import class_map

        every = class_map(graph, EDGES).select(F.col("rep").alias("edge")).distinct()
    else:
        every = graph.incidences.select("edge").distinct()
    levels = cut_lineage(every.join(vertices, "edge", "left").withColumn("level", F.lit(0)))
    for _ in range(most_rounds):
        up = links.join(levels.withColumnRenamed("edge", "src"), "src").groupBy("dst").agg((F.max("level") + 1).alias("up"))
        new = cut_lineage(levels.join(up.withColumnRenamed("dst", "edge"), "edge", "left").select("edge", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), F.col("level").alias("old")))
        if new.filter("level > old").isEmpty():
            links.unpersist()
            return new.select("edge", "level")
        levels = new.select("edge", "level")
    raise SetGraphError("levels didn't settle")


def sort_left_by_right(graph: HGraph, positions: DataFrame, level: int = NODES) -> DataFrame:
    """id, position: the ids of a level by the mean position of what they are incident to; positions: id, position."""
    own, other = ("node", "edge") if level == NODES else ("edge", "node")
    met = graph.pairs.join(positions.select(F.col("id").alias(other), "position"), other)
    return met.groupBy(F.col(own).alias("id")).agg(F.avg("position").alias("position")).orderBy("position", "id")


def extents(graph: HGraph, positions: DataFrame) -> DataFrame:
    """edge, low, high: the least and greatest position of an edge's nodes; positions: id, position."""
    return graph.pairs.join(positions.select(F.col("id").alias("node"), "position"), "node").groupBy("edge").agg(F.min("position").alias("low"), F.max("position").alias("high"))
