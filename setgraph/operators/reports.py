"""Distributions of sizes, degrees, components and diameters, and summaries of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TooLargeError
from ..graph import EDGES, NODES, HGraph
from . import connectivity
from .pairs import neighbors, toplexes

#: The longest list of values in dist_stats.
MOST_VALUES = 1_000_000


def _histogram(values: DataFrame, value: str) -> DataFrame:
    return values.groupBy(value).agg(F.count("*").alias("n"))


def edge_size_dist(graph: HGraph, aggregated: bool = False) -> DataFrame:
    """edge, size; or size, n."""
    sizes = graph.edge_sizes()
    return _histogram(sizes, "size") if aggregated else sizes


def degree_dist(graph: HGraph, aggregated: bool = False) -> DataFrame:
    """node, degree; or degree, n."""
    degrees = graph.node_degrees()
    return _histogram(degrees, "degree") if aggregated else degrees


def s_comp_dist(graph: HGraph, s: int = 1, aggregated: bool = False, edges: bool = True, return_singletons: bool = True) -> DataFrame:
    """component, size of s-components of edges (or nodes); or size, n."""
    sizes = connectivity.component_labels(graph, s, edges).groupBy("component").agg(F.count("*").alias("size"))
    sizes = sizes if return_singletons else sizes.filter("size > 1")
    return _histogram(sizes, "size") if aggregated else sizes


def comp_dist(graph: HGraph, aggregated: bool = False) -> DataFrame:
    """component, number of nodes; or that number, n."""
    return s_comp_dist(graph, 1, aggregated, edges=False)


def toplex_dist(graph: HGraph, aggregated: bool = False) -> DataFrame:
    """edge, size of toplexes; or size, n."""
    sizes = graph.edge_sizes().join(toplexes(graph), "edge", "left_semi")
    return _histogram(sizes, "size") if aggregated else sizes


def _diameters(graph: HGraph, edges: bool, most: int = 1000) -> list[int]:
    found = []
    for s in range(1, most):
        if not connectivity.is_connected(graph, s, edges):
            break
        found.append(connectivity._diameters(graph, s, edges)[0])
    return found


def s_node_diameter_dist(graph: HGraph) -> list[int]:
    """Diameters for s = 1, 2, ... as long as the nodes are s-connected."""
    return _diameters(graph, False)


def s_edge_diameter_dist(graph: HGraph) -> list[int]:
    """Diameters for s = 1, 2, ... as long as the edges are s-connected."""
    return _diameters(graph, True)


def centrality_stats(values: DataFrame, column: str = "value") -> list[float]:
    """Minimum, maximum, mean, median and population standard deviation."""
    c = F.col(column)
    return [None if x is None else float(x) for x in values.agg(F.min(c), F.max(c), F.avg(c), F.median(c), F.stddev_pop(c)).first()]


def info_table(graph: HGraph) -> DataFrame:
    """One row: nrows (nodes), ncols (edges), aspect_ratio, ncells, density."""
    counts = graph.incidences.agg(F.countDistinct("node").alias("nrows"), F.countDistinct("edge").alias("ncols"), F.count("*").alias("ncells"))
    ratio = F.when(F.col("ncols") > 0, F.col("nrows") / F.col("ncols")).otherwise(F.lit(0.0))
    density = F.when(F.col("ncells") > 0, F.col("ncells") / (F.col("nrows") * F.col("ncols"))).otherwise(F.lit(0.0))
    return counts.select("nrows", "ncols", ratio.alias("aspect_ratio"), "ncells", density.alias("density"))


def info_dict(graph: HGraph, node=None, edge=None) -> dict:
    """Numbers of the graph; of a node its edges, degree and neighbours; of an edge its size and nodes."""
    if node is not None:
        found = sorted(r[0] for r in graph.neighbors_of(NODES, node).collect())
        return {"membs": found, "degree": len(found), "neighbors": neighbors(graph, node)} if found else {}
    if edge is not None:
        found = sorted(r[0] for r in graph.neighbors_of(EDGES, edge).collect())
        return {"size": len(found), "elements": found} if found else {}
    return info_table(graph).first().asDict()


def info(graph: HGraph, node=None, edge=None) -> str:
    """info_dict as text."""
    found = info_dict(graph, node, edge)
    what = f"Node {node!r}" if node is not None else f"Edge {edge!r}" if edge is not None else str(graph)
    if not found:
        return f"{what}: not in the graph"
    return "\n".join([what, *(f"{k}: {v}" for k, v in found.items())])


def dist_stats(graph: HGraph, lists: bool = True) -> dict:
    """Sizes, degrees and components: sorted values from the largest, statistics, histograms, maxima, numbers.

    The sorted values have an entry for each edge, node or component, and more than MOST_VALUES raise; without lists
    only the histograms, one entry for each different value, come to the driver.
    """
    out = info_dict(graph)
    for name, table, column in (
        ("edge_size", edge_size_dist(graph), "size"),
        ("degree", degree_dist(graph), "degree"),
        ("s_comp_size", s_comp_dist(graph), "size"),
    ):
        table = table.persist()
        hist = {r[0]: r[1] for r in _histogram(table, column).orderBy(column).collect()}
        out[f"{name}_hist"] = hist
        if lists:
            if sum(hist.values()) > MOST_VALUES:
                raise TooLargeError(f"{name}: a list of more than {MOST_VALUES} values; ask for no lists")
            out[f"{name}_list"] = [v for v in sorted(hist, reverse=True) for _ in range(hist[v])]
        out[f"{name}_stats"] = centrality_stats(table, column)
        out[f"max_{name}"] = max(hist, default=0)
        table.unpersist()
    out["num_s_comps"] = sum(out["s_comp_size_hist"].values())
    return out
