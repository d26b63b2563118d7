"""s-connected components, s-distances and s-diameters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SetGraphError
from ..graph import EDGES, NODES, HGraph, side
from ..plans.guards import bounded_rows
from ..plans.lineage import cut_lineage, written
from . import components as stars
from .distances import all_pairs, eccentricities, incident_source, reach, single_source
from .pairs import get_linegraph, pair_counts

#: Ids that a list of all components holds at most.
MOST_LISTED = 1_000_000


def bipartite_components(graph: HGraph) -> DataFrame:
    """level, id (as text), component: components of edges and nodes together, named by the least id of the side with fewer.

    The links are those from each id of that side to the least one that shares an id of the other side with it: no more
    than the incidences, where the line graph of one hub would be quadratic, and among the ids of the lesser side only.
    """
    pairs = written(graph.pairs)
    n_edges, n_nodes = pairs.agg(F.approx_count_distinct("edge"), F.approx_count_distinct("node")).first()
    kept, passed = (EDGES, NODES) if n_edges < n_nodes else (NODES, EDGES)
    own, other = side(kept)
    least = pairs.groupBy(other).agg(F.min(own).alias("_least"))
    found = stars.connected_components(pairs.join(least, other).filter(F.col(own) != F.col("_least")).select(F.col(own).alias("src"), F.col("_least").alias("dst")))
    labels = pairs.select(F.col(own).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    through = least.join(labels, F.col("_least") == F.col("id")).select(F.lit(passed).alias("level"), F.col(other).cast("string").alias("id"), "component")
    return labels.select(F.lit(kept).alias("level"), F.col("id").cast("string").alias("id"), "component").unionByName(through)


def component_labels(graph: HGraph, s: int = 1, edges: bool = True) -> DataFrame:
    """id, component: the least id of its s-connected component, for every edge (or node)."""
    level = EDGES if edges else NODES
    own, _ = side(level)
    kind = graph.incidences.schema[own].dataType
    if s <= 1:
        found = bipartite_components(graph).filter(F.col("level") == level).select(F.col("id").cast(kind).alias("id"), F.col("component").alias("_c"))
        least = found.groupBy("_c").agg(F.min("id").alias("component"))
        return found.join(least, "_c").select("id", "component")
    vertices, links = get_linegraph(graph, s, edges)
    found = stars.connected_components(links)
    return vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def s_connected_components(graph: HGraph, s: int = 1, edges: bool = True, return_singletons: bool = False) -> DataFrame:
    """component and members (a sorted array); components of one id only where return_singletons is set."""
    found = component_labels(graph, s, edges).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return found if return_singletons else found.filter(F.size("members") > 1)


def s_components(graph: HGraph, s: int = 1, edges: bool = True, return_singletons: bool = True) -> DataFrame:
    return s_connected_components(graph, s, edges, return_singletons)


def connected_components(graph: HGraph, edges: bool = False) -> DataFrame:
    return s_connected_components(graph, 1, edges, True)


def components(graph: HGraph, edges: bool = False) -> DataFrame:
    return connected_components(graph, edges)


def is_connected(graph: HGraph, s: int = 1, edges: bool = False) -> bool:
    """Whether there is exactly one component; an empty graph isn't connected."""
    return len(component_labels(graph, s, edges).select("component").distinct().take(2)) == 1


def labelled_incidences(graph: HGraph, s: int = 1, edges: bool = True, return_singletons: bool = False) -> DataFrame:
    """The incidences with the component of their edge (or node): all component subgraphs in one table."""
    own, _ = side(EDGES if edges else NODES)
    labels = component_labels(graph, s, edges)
    if not return_singletons:
        labels = labels.join(labels.groupBy("component").count().filter("count > 1"), "component", "left_semi")
    return graph.incidences.join(labels.withColumnRenamed("id", own), own)


def write_component_subgraphs(graph: HGraph, folder: str, s: int = 1, edges: bool = True, return_singletons: bool = False) -> None:
    """All component subgraphs, written by one job to a folder of the shared file system.

    Incidences are sorted by component, so that component_subgraph reads only the row groups that hold its own; a
    component with most of the rows is spread over files by its edge (or node).
    """
    own, _ = side(EDGES if edges else NODES)
    rows = labelled_incidences(graph, s, edges, return_singletons)
    rows.repartitionByRange("component", own).sortWithinPartitions("component").write.mode("overwrite").parquet(folder)


def component_subgraph(graph: HGraph, folder: str, component, name: str | None = None) -> HGraph:
    """One component (named by its least id) of those that write_component_subgraphs wrote, with the graph's properties."""
    found = graph.spark.read.parquet(folder).filter(F.col("component") == F.lit(component))
    return replace(graph, incidences=found.select(*graph.incidences.columns), name=name or f"{graph.name}:{component}")


def s_component_subgraphs(graph: HGraph, s: int = 1, edges: bool = True, return_singletons: bool = False, name: str | None = None) -> Iterator[HGraph]:
    """A restricted graph for each component, named name:i, by least id.

    Components are found and joined with the incidences once; each graph is a filter of that table. For many components
    use write_component_subgraphs, or labelled_incidences as a whole.
    """
    labelled = cut_lineage(labelled_incidences(graph, s, edges, return_singletons))
    for i, row in enumerate(labelled.select("component").distinct().orderBy("component").toLocalIterator()):
        own = labelled.filter(F.col("component") == F.lit(row["component"]))
        yield replace(graph, incidences=own.select(*graph.incidences.columns), name=f"{name or graph.name}:{i}")


def connected_component_subgraphs(graph: HGraph, return_singletons: bool = True, name: str | None = None) -> Iterator[HGraph]:
    return s_component_subgraphs(graph, 1, True, return_singletons, name)


def component_subgraphs(graph: HGraph, return_singletons: bool = False, name: str | None = None) -> Iterator[HGraph]:
    return s_component_subgraphs(graph, 1, True, return_singletons, name)


def s_distances(graph: HGraph, s: int = 1, edges: bool = True) -> tuple[DataFrame, DataFrame]:
    """vertices (id) and all connected pairs (src, dst, distance) of the s-line graph."""
    vertices, links = get_linegraph(graph, s, edges)
    return vertices, all_pairs(vertices, links)


def component_diameters(graph: HGraph, s: int = 1, edges: bool = False) -> DataFrame:
    """component, diameter, size: the greatest s-distance within each component, and how many ids it has."""
    vertices, links = get_linegraph(graph, s, edges)
    if s <= 1:
        labels = component_labels(graph, s, edges)
    else:
        links = cut_lineage(links.select("src", "dst"))
        labels = vertices.join(stars.connected_components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    found = labels.join(reach(vertices, links), "id")
    return found.groupBy("component").agg(F.max("far").alias("diameter"), F.count("*").alias("size"))


def _diameters(graph: HGraph, s: int, edges: bool) -> tuple[int, list, list]:
    """Lists of all components and their members, so bounded by MOST_LISTED ids."""
    rows = cut_lineage(component_diameters(graph, s, edges))
    listed = bounded_rows(component_labels(graph, s, edges), MOST_LISTED, "members of components")
    members: dict = {}
    for r in listed:
        members.setdefault(r["component"], set()).add(r["id"])
    found = sorted(rows.collect(), key=lambda r: r["component"])
    return max((r["diameter"] for r in found), default=0), [r["diameter"] for r in found], [members[r["component"]] for r in found]


def node_diameters(graph: HGraph, s: int = 1) -> tuple[int, list, list]:
    """The greatest diameter, the diameters and the members of all s-components of nodes."""
    return _diameters(graph, s, False)


def edge_diameters(graph: HGraph, s: int = 1) -> tuple[int, list, list]:
    """The same of edges."""
    return _diameters(graph, s, True)


def _diameter(graph: HGraph, s: int, edges: bool) -> int:
    if not is_connected(graph, s, edges):
        raise SetGraphError(f"the graph isn't {s}-connected")
    own, other = side(EDGES if edges else NODES)
    found = eccentricities(graph.pairs, own, other) if s <= 1 else reach(*get_linegraph(graph, s, edges))
    return found.agg(F.coalesce(F.max("far"), F.lit(0))).first()[0]


def diameter(graph: HGraph, s: int = 1) -> int:
    """The greatest s-distance of two nodes; raises if the graph isn't s-connected."""
    return _diameter(graph, s, False)


def edge_diameter(graph: HGraph, s: int = 1) -> int:
    """The greatest s-distance of two edges; raises if the graph isn't s-connected."""
    return _diameter(graph, s, True)


def _distance(graph: HGraph, source, target, s: int, edges: bool) -> float:
    level = EDGES if edges else NODES
    own, other = side(level)
    known = {r[0] for r in graph.incidences.filter(F.col(own).isin(source, target)).select(own).distinct().collect()}
    if source not in known or target not in known:
        return math.inf
    if source == target:
        return 0
    seen = incident_source(graph.pairs, own, other, source, target) if s <= 1 else single_source(pair_counts(graph, level, s), source, target)
    found = seen.filter(F.col("id") == F.lit(target)).collect()
    return found[0]["distance"] if found else math.inf


def distance(graph: HGraph, source, target, s: int = 1) -> float:
    """The length of the shortest s-walk between two nodes; infinite without one, or for an unknown node."""
    return _distance(graph, source, target, s, False)


def edge_distance(graph: HGraph, source, target, s: int = 1) -> float:
    """The length of the shortest s-walk between two edges; infinite without one, or for an unknown edge."""
    return _distance(graph, source, target, s, True)
