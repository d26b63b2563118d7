"""Restriction, removal, addition, duals, renaming, collapse and set operations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SetGraphError
from ..functions.properties import aggregated, merged, no_properties
from ..graph import EDGES, INCIDENCES, NODES, HGraph, Properties, id_table, side
from ..sources.normalise import keep_first

#: Lists given by the caller are broadcast up to this many ids; tables are joined as Spark sees fit.
LISTED = 100_000


def _ids(graph: HGraph, ids: Iterable | DataFrame, column: str) -> DataFrame:
    found = id_table(graph.spark, ids, graph.incidences.schema[column].dataType, column)
    return found if isinstance(ids, DataFrame) or len(list(ids)) > LISTED else F.broadcast(found)


def dual(graph: HGraph, name: str | None = None, share_properties: bool = True) -> HGraph:
    """Edges and nodes change places, and their properties with them."""
    rest = [c for c in graph.incidences.columns if c not in ("edge", "node")]
    table = graph.incidences.select(F.col("node").alias("edge"), F.col("edge").alias("node"), *rest)
    if not share_properties:
        return HGraph.of(table, graph.default_cell_weight, name or graph.name)
    return replace(graph, incidences=table, edge_properties=graph.node_properties, node_properties=graph.edge_properties, name=name or graph.name)


def restrict_to(graph: HGraph, level: int, ids: Iterable | DataFrame, name: str | None = None) -> HGraph:
    """Only the incidences whose edge (level 0) or node (1) is among ids."""
    own, _ = side(level)
    ids = ids if isinstance(ids, DataFrame) else list(ids)
    return replace(graph, incidences=graph.incidences.join(_ids(graph, ids, own), own, "left_semi").select(*graph.incidences.columns), name=name or graph.name)


def restrict_to_edges(graph: HGraph, edges: Iterable | DataFrame, name: str | None = None) -> HGraph:
    return restrict_to(graph, EDGES, edges, name)


def restrict_to_nodes(graph: HGraph, nodes: Iterable | DataFrame, name: str | None = None) -> HGraph:
    return restrict_to(graph, NODES, nodes, name)


def _remove(graph: HGraph, level: int, ids: Iterable | DataFrame, name: str | None) -> HGraph:
    own, _ = side(level)
    ids = ids if isinstance(ids, DataFrame) else list(ids)
    gone = _ids(graph, ids, own)
    table = graph.incidences.join(gone, own, "left_anti").select(*graph.incidences.columns)
    props = graph.edge_properties if level == EDGES else graph.node_properties
    left = replace(props, table=props.table.join(gone.withColumnRenamed(own, "uid"), "uid", "left_anti").select(*props.table.columns))
    return replace(graph, incidences=table, name=name or graph.name, **{"edge_properties" if level == EDGES else "node_properties": left})


def remove_edges(graph: HGraph, edges: Iterable | DataFrame, name: str | None = None) -> HGraph:
    """Without these edges and their properties."""
    return _remove(graph, EDGES, edges, name)


def remove_nodes(graph: HGraph, nodes: Iterable | DataFrame, name: str | None = None) -> HGraph:
    """Without these nodes and their properties."""
    return _remove(graph, NODES, nodes, name)


def remove_incidences(graph: HGraph, incidences: Iterable | DataFrame, name: str | None = None) -> HGraph:
    """Without these (edge, node) pairs; a bare edge id stands for all of its pairs. Properties of ids stay."""
    table = graph.incidences
    kinds = {c: table.schema[c].dataType.simpleString() for c in ("edge", "node")}
    if isinstance(incidences, DataFrame):
        pairs, edges = incidences.select("edge", "node"), None
    else:
        given = list(incidences)
        pairs = graph.spark.createDataFrame([p for p in given if isinstance(p, (tuple, list))], f"edge {kinds['edge']}, node {kinds['node']}")
        edges = [p for p in given if not isinstance(p, (tuple, list))]
    table = table.join(pairs, ["edge", "node"], "left_anti")
    if edges:
        table = table.join(_ids(graph, edges, "edge"), "edge", "left_anti")
    return replace(graph, incidences=table.select(*graph.incidences.columns), name=name or graph.name)


def rename(graph: HGraph, edges: Mapping | DataFrame | None = None, nodes: Mapping | DataFrame | None = None, name: str | None = None) -> HGraph:
    """New ids by mappings (or tables with columns old and new); other ids stay. Of incidences and properties that
    meet under one id, those of the least old id stay."""
    table, changed = graph.incidences, {}
    for level, given in ((EDGES, edges), (NODES, nodes)):
        if given is None:
            continue
        own, _ = side(level)
        kind = graph.incidences.schema[own].dataType
        mapping = given if isinstance(given, DataFrame) else graph.spark.createDataFrame(list(given.items()), f"old {kind.simpleString()}, new {kind.simpleString()}")
        mapping = mapping.select(F.col("old").cast(kind).alias("_old"), F.col("new").cast(kind).alias("_new"))
        if not isinstance(given, DataFrame) and len(given) <= LISTED:
            mapping = F.broadcast(mapping)
        table = table.join(mapping, table[own] == F.col("_old"), "left").withColumn(f"_was_{own}", F.col(own)).withColumn(own, F.coalesce("_new", own)).drop("_old", "_new")
        props = graph.edge_properties if level == EDGES else graph.node_properties
        moved = props.table.join(mapping, props.table["uid"] == F.col("_old"), "left").withColumn("_was", F.col("uid")).withColumn("uid", F.coalesce("_new", "uid")).drop("_old", "_new")
        changed["edge_properties" if level == EDGES else "node_properties"] = replace(props, table=keep_first(moved, ["uid"], "_was").drop("_was"))
    was = [c for c in ("_was_edge", "_was_node") if c in table.columns]
    if was:
        table = keep_first(table.withColumn("_was", F.struct(*was)), ["edge", "node"], "_was").drop("_was", *was)
    return replace(graph, incidences=table.select(*graph.incidences.columns), name=name or graph.name, **changed)


# -- identical elements -------------------------------------------------------------------------------------------


def class_map(graph: HGraph, level: int, use_uids: Iterable | None = None) -> DataFrame:
    """id, rep, members: ids with the same neighbours share a representative, the least id or, where there are some,
    the least of use_uids."""
    own, other = side(level)
    key = graph.incidences.groupBy(own).agg(F.array_sort(F.collect_set(other)).alias("_key"))
    if use_uids is not None:
        preferred = _ids(graph, list(use_uids), own).withColumn("_wanted", F.lit(0))
        key = key.join(preferred, own, "left")
    else:
        key = key.withColumn("_wanted", F.lit(None).cast("int"))
    rep = F.min(F.struct(F.coalesce("_wanted", F.lit(1)).alias("w"), F.col(own).alias("id")))
    classes = key.groupBy("_key").agg(rep["id"].alias("rep"), F.count("*").alias("members"))
    return key.join(classes, "_key").select(F.col(own).alias("id"), "rep", "members")


def equivalence_classes(graph: HGraph, edges: bool = True) -> DataFrame:
    """rep and members (a sorted array): ids of edges (or nodes) with identical neighbours."""
    own, other = side(EDGES if edges else NODES)
    key = graph.incidences.groupBy(own).agg(F.array_sort(F.collect_set(other)).alias("_key"))
    classes = key.groupBy("_key").agg(F.array_sort(F.collect_list(own)).alias("members"))
    return classes.select(F.element_at("members", 1).alias("rep"), "members")


def aggregate_rows(df: DataFrame, keys: list[str], rules: Mapping[str, str | Callable], order: str) -> DataFrame:
    """One row a key, each column by its rule (a name or a callable), the first by `order` where there is none. misc keeps
    the first map."""
    by = {c: "first" if "map" in kind else rules.get(c, "first") for c, kind in df.dtypes if c not in keys and c != order}
    return aggregated(df, keys, by, order)


def _collapse(graph: HGraph, level: int, name, use_uids, use_counts, return_counts, properties_by, cells_by) -> tuple[HGraph, DataFrame]:
    own, other = side(level)
    classes = class_map(graph, level, use_uids)
    kind = graph.incidences.schema[own].dataType
    label = F.concat_ws(":", "rep", "members") if use_counts else F.col("rep")
    classes = classes.withColumn("_label", label)
    cells = graph.incidences.join(classes, graph.incidences[own] == F.col("id")).withColumn("_was", F.col(own)).withColumn(own, F.col("_label")).drop("id", "rep", "members", "_label")
    cells = aggregate_rows(cells, [own, other], {"weight": "sum", **(cells_by or {})}, "_was").select(*graph.incidences.columns)
    props = graph.edge_properties if level == EDGES else graph.node_properties
    stored = props.table.join(classes, props.table["uid"] == F.col("id"))
    stored = stored.withColumn("_was", F.struct((F.col("id") != F.col("rep")).alias("a"), F.col("id").alias("b"))).withColumn("uid", F.col("_label")).drop("id", "rep", "members", "_label")
    stored = aggregate_rows(stored, ["uid"], {"weight": "sum", **(properties_by or {})}, "_was").select(*props.table.columns)
    if return_counts:
        counts = classes.select(F.col("_label").alias("uid"), "members").distinct()
        joined = counts.join(stored, "uid", "left")
        misc = merged(F.create_map(F.lit("equivalence_class_size"), F.col("members").cast("string")), F.coalesce("misc", no_properties()))
        stored = joined.withColumn("weight", F.coalesce("weight", F.lit(props.defaults["weight"]))).withColumn("misc", misc).drop("members").select(*props.table.columns)
    assert use_counts or cells.schema[own].dataType == kind
    changed = {"edge_properties" if level == EDGES else "node_properties": replace(props, table=stored)}
    found = classes.groupBy("_label").agg(F.array_sort(F.collect_list("id")).alias("members")).withColumnRenamed("_label", "rep")
    return replace(graph, incidences=cells, name=name or graph.name, **changed), found


def collapse_edges(graph: HGraph, name=None, use_uids=None, use_counts=False, return_counts=True, return_equivalence_classes=False, aggregate_edges_by=None, aggregate_cells_by=None):
    """Identical edges become one: weights add up unless a rule says otherwise, other values are those of the first.

    use_counts names a class `representative:size`; return_counts stores its size as equivalence_class_size. A rule may be
    a callable of a pandas Series: a class that holds many edges is then one group of values in a task.
    """
    out, found = _collapse(graph, EDGES, name, use_uids, use_counts, return_counts, aggregate_edges_by, aggregate_cells_by)
    return (out, found) if return_equivalence_classes else out


def collapse_nodes(graph: HGraph, name=None, use_uids=None, use_counts=False, return_counts=True, return_equivalence_classes=False, aggregate_nodes_by=None, aggregate_cells_by=None):
    """Nodes in the same edges become one; see collapse_edges."""
    out, found = _collapse(graph, NODES, name, use_uids, use_counts, return_counts, aggregate_nodes_by, aggregate_cells_by)
    return (out, found) if return_equivalence_classes else out


def collapse_nodes_and_edges(
    graph: HGraph, name=None, use_edge_uids=None, use_node_uids=None, use_counts=False, return_counts=True, return_equivalence_classes=False,
    aggregate_nodes_by=None, aggregate_edges_by=None, aggregate_cells_by=None,
):
    """Nodes first, then edges."""
    middle, nodes = _collapse(graph, NODES, name, use_node_uids, use_counts, return_counts, aggregate_nodes_by, aggregate_cells_by)
    out, edges = _collapse(middle, EDGES, name, use_edge_uids, use_counts, return_counts, aggregate_edges_by, aggregate_cells_by)
    return (out, {"nodes": nodes, "edges": edges}) if return_equivalence_classes else out


def singletons(graph: HGraph) -> DataFrame:
    """Edges of one node that is in no other edge."""
    one = graph.incidences.groupBy("edge").agg(F.count("*").alias("size"), F.min("node").alias("node")).filter("size = 1")
    lone = graph.node_degrees().filter("degree = 1").select("node")
    return one.join(lone, "node", "left_semi").select("edge")


def remove_singletons(graph: HGraph, name: str | None = None) -> HGraph:
    return remove_edges(graph, singletons(graph), name)


# -- additions ----------------------------------------------------------------------------------------------------


def _with_attributes(uids: Iterable) -> list[tuple]:
    return [(u[0], dict(u[1])) if isinstance(u, (tuple, list)) and len(u) == 2 and isinstance(u[1], Mapping) else (u, {}) for u in uids]


def add_edges_from(graph: HGraph, uids: Iterable) -> HGraph:
    """Property rows for edges: ids, or (id, mapping). An edge is visible only with an incidence."""
    return replace(graph, edge_properties=graph.edge_properties.upsert(_with_attributes(uids)))


def add_edge(graph: HGraph, uid, **attributes) -> HGraph:
    return add_edges_from(graph, [(uid, attributes)])


def add_nodes_from(graph: HGraph, uids: Iterable) -> HGraph:
    """Property rows for nodes: ids, or (id, mapping)."""
    return replace(graph, node_properties=graph.node_properties.upsert(_with_attributes(uids)))


def add_node(graph: HGraph, uid, **attributes) -> HGraph:
    return add_nodes_from(graph, [(uid, attributes)])


def add_incidences_from(graph: HGraph, incidences: Iterable | DataFrame) -> HGraph:
    """New pairs, or new values for known ones: (edge, node) or (edge, node, mapping); or a normalised table, whose
    rows replace known ones."""
    if isinstance(incidences, DataFrame):
        old = graph.incidences.join(incidences, ["edge", "node"], "left_anti")
        return replace(graph, incidences=old.unionByName(incidences, allowMissingColumns=True).select(*graph.incidences.columns))
    cells = Properties(graph.incidences, ("edge", "node"), {"weight": graph.default_cell_weight})
    return replace(graph, incidences=cells.upsert([((i[0], i[1]), dict(i[2]) if len(i) > 2 else {}) for i in incidences]).table)


def add_incidence(graph: HGraph, edge, node, **attributes) -> HGraph:
    return add_incidences_from(graph, [(edge, node, attributes)])


def add_nodes_to_edges(graph: HGraph, edges: Mapping) -> HGraph:
    """From {edge: [nodes]} or {edge: {node: mapping}}."""
    new = []
    for edge, nodes in edges.items():
        new += [(edge, n, nodes[n] if isinstance(nodes, Mapping) else {}) for n in nodes]
    return add_incidences_from(graph, new)


# -- set operations -----------------------------------------------------------------------------------------------


def _first_wins(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b.join(a.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def sum(graph: HGraph, other: HGraph, name: str | None = None) -> HGraph:  # noqa: A001
    """All incidences and properties of both; where both have one, graph's."""
    if not isinstance(other, HGraph):
        raise SetGraphError("the other operand isn't a hypergraph")
    edges, nodes = (replace(p, table=_first_wins(p.table, q.table, ["uid"])) for p, q in ((graph.edge_properties, other.edge_properties), (graph.node_properties, other.node_properties)))
    return replace(graph, incidences=_first_wins(graph.incidences, other.incidences, ["edge", "node"]), edge_properties=edges, node_properties=nodes, name=name or graph.name)


def union(graph: HGraph, other: HGraph, name: str | None = None) -> HGraph:
    return sum(graph, other, name)


def difference(graph: HGraph, other: HGraph, name: str | None = None) -> HGraph:
    """The incidences that other lacks."""
    return replace(graph, incidences=graph.incidences.join(other.pairs, ["edge", "node"], "left_anti").select(*graph.incidences.columns), name=name or graph.name)


def intersection(graph: HGraph, other: HGraph, name: str | None = None) -> HGraph:
    """The incidences of both, with graph's properties."""
    return replace(graph, incidences=graph.incidences.join(other.pairs, ["edge", "node"], "left_semi").select(*graph.incidences.columns), name=name or graph.name)


__all__ = [x for x in dir() if not x.startswith("_") and x not in ("INCIDENCES", "annotations")]
