"""Hypergraphs from Python collections and from matrices."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SetGraphError
from ..functions.properties import encode_value
from ..graph import HGraph
from .normalise import ORDER


def _id_type(values: Iterable) -> str:
    """The narrowest type of a column of ids; ids of several kinds are text."""
    kinds = {type(v) for v in values}
    for names, kind in (((int, bool, np.bool_, np.int64, np.int32), "bigint"), ((str,), "string"), ((int, float, np.int64, np.float64), "double"), ((datetime.datetime,), "timestamp"), ((datetime.date,), "date")):
        if kinds <= set(names):
            return kind
    return "string"


def _as_ids(values: Sequence, kind: str) -> list:
    cast = {"bigint": int, "double": float, "string": str}.get(kind)
    return [None if v is None else cast(v) for v in values] if cast else list(values)


def hypergraph(spark: SparkSession, setsystem=None, **options) -> HGraph:
    """A hypergraph from what there is: a table (Spark's or pandas'), a dict of edges, a list of sets, an array of pairs, or nothing.

    A table's first two columns are edges and nodes unless options say otherwise (see HGraph.from_dataframe).
    """
    if setsystem is None:
        return from_dict(spark, {}, **options)
    if isinstance(setsystem, HGraph):
        return setsystem
    if isinstance(setsystem, pd.DataFrame):
        setsystem = spark.createDataFrame(setsystem)
    if isinstance(setsystem, DataFrame):
        return HGraph.from_dataframe(setsystem, **options)
    if isinstance(setsystem, Mapping):
        return from_dict(spark, setsystem, **options)
    if isinstance(setsystem, np.ndarray):
        return from_pairs(spark, setsystem, **options)
    if isinstance(setsystem, Iterable) and not isinstance(setsystem, str):
        return from_lists(spark, setsystem, **options)
    raise SetGraphError(f"a hypergraph can't be made from a {type(setsystem).__name__}")


def _from_rows(spark: SparkSession, rows: list[tuple], default_weight: float, name: str | None, aggregate_by, properties: dict) -> HGraph:
    """rows: (edge, node, mapping)."""
    edge_kind, node_kind = _id_type(r[0] for r in rows), _id_type(r[1] for r in rows)
    data = []
    edges, nodes = _as_ids([r[0] for r in rows], edge_kind), _as_ids([r[1] for r in rows], node_kind)
    for at, (edge, node, (_, _, values)) in enumerate(zip(edges, nodes, rows, strict=True)):
        values = dict(values)
        weight = values.pop("weight", None)
        data.append((at, edge, node, None if weight is None else float(weight), {str(k): encode_value(v) for k, v in values.items()}))
    df = spark.createDataFrame(data, f"{ORDER} long, edge {edge_kind}, node {node_kind}, weight double, misc map<string,string>")
    return HGraph.from_dataframe(df, "edge", "node", "weight", "misc", default_weight, aggregate_by, ORDER, name, **properties)


def from_dict(spark: SparkSession, setsystem: Mapping, default_cell_weight: float = 1.0, name: str | None = None, aggregate_by="first", **properties) -> HGraph:
    """From {edge: [nodes]} or {edge: {node: mapping or weight}}; kinds may be mixed."""
    rows = []
    for edge, nodes in setsystem.items():
        for node in nodes:
            values = nodes[node] if isinstance(nodes, Mapping) else {}
            rows.append((edge, node, values if isinstance(values, Mapping) else {"weight": values}))
    return _from_rows(spark, rows, default_cell_weight, name, aggregate_by, properties)


def from_lists(spark: SparkSession, sets: Iterable[Iterable], default_cell_weight: float = 1.0, name: str | None = None, **properties) -> HGraph:
    """From a list of sets; an edge's id is its place."""
    return from_dict(spark, dict(enumerate(map(list, sets))), default_cell_weight, name, **properties)


def from_array_column(df: DataFrame, nodes: str, edge: str | None = None, **options) -> HGraph:
    """From a table with an array of nodes in each row; without an id column edges are numbered by their rows' order."""
    if edge is None:
        df, edge = df.withColumn("_edge", F.monotonically_increasing_id()), "_edge"
    flat = df.select(F.col(edge).alias("edge"), F.posexplode(nodes).alias(ORDER, "node"))
    return HGraph.from_dataframe(flat, "edge", "node", order_col=ORDER, **options)


def from_pairs(spark: SparkSession, pairs: np.ndarray | Sequence, **options) -> HGraph:
    """From an array of shape (n, 2): edge, node."""
    array = np.asarray(pairs)
    if array.ndim != 2 or array.shape[1] != 2:
        raise SetGraphError("an array has to have two columns, edge and node")
    return _from_rows(spark, [(e, n, {}) for e, n in array.tolist()], options.pop("default_cell_weight", 1.0), options.pop("name", None), options.pop("aggregate_by", "first"), options)


def from_bipartite(vertices: DataFrame, links: DataFrame, node_side=1, name: str | None = None, **options) -> HGraph:
    """From vertices (id, bipartite) and links (src, dst): ids whose side is node_side are nodes, the others edges.

    Raises if a link joins two ids of one side.
    """
    sided = vertices.select("id", (F.col("bipartite") == F.lit(node_side)).alias("is_node"))
    met = links.join(sided.toDF("src", "src_node"), "src").join(sided.toDF("dst", "dst_node"), "dst")
    if not met.filter(F.col("src_node") == F.col("dst_node")).isEmpty():
        raise SetGraphError("a link joins two vertices of one side")
    edge = F.when(F.col("src_node"), F.col("dst")).otherwise(F.col("src"))
    node = F.when(F.col("src_node"), F.col("src")).otherwise(F.col("dst"))
    rest = [c for c in links.columns if c not in ("src", "dst")]
    return HGraph.from_dataframe(met.select(edge.alias("edge"), node.alias("node"), *rest), "edge", "node", name=name, **options)


def from_long_matrix(cells: DataFrame, row: str = "i", col: str = "j", value: str = "value", key: Callable[[Column], Column] | None = None, name: str | None = None) -> HGraph:
    """From a matrix in long form: rows are nodes, columns edges, values that aren't 0 (or pass key) weights."""
    kept = cells.filter(key(F.col(value)) if key else F.col(value) != 0)
    weight = F.col(value).cast("double")
    return HGraph.from_dataframe(kept.select(F.col(col).alias("edge"), F.col(row).alias("node"), weight.alias("weight")), "edge", "node", name=name)


def _cells(spark: SparkSession, matrix, zeros: bool = False) -> tuple[DataFrame, tuple[int, int]]:
    """i, j, value, and the shape. zeros: those of a dense matrix too; a sparse one has the cells that it stores.

    Arrays go to Spark as Arrow columns, not as rows of Python objects. Cells that are stored more than once add up.
    """
    if hasattr(matrix, "tocoo"):
        matrix = matrix.tocoo()
    if all(hasattr(matrix, part) for part in ("row", "col", "data", "shape")):
        shape, i, j, value = tuple(matrix.shape), np.asarray(matrix.row), np.asarray(matrix.col), np.asarray(matrix.data)
    else:
        matrix = np.asarray(matrix)
        if matrix.ndim != 2:
            raise SetGraphError("a matrix has two dimensions")
        shape = matrix.shape
        i, j = (a.ravel() for a in np.indices(shape)) if zeros else np.nonzero(matrix)
        value = matrix[i, j]
    table = pa.table({"i": pa.array(i.astype(np.int64)), "j": pa.array(j.astype(np.int64)), "value": pa.array(value.astype(float))})
    return spark.createDataFrame(table).groupBy("i", "j").agg(F.sum("value").alias("value")), shape


def _named(cells: DataFrame, column: str, names: Sequence | None, n: int, letter: str) -> DataFrame:
    """Places in a column become names, by default the letter and the place."""
    if names is None:
        return cells.withColumn(column, F.concat(F.lit(letter), F.col(column).cast("string")))
    names = list(names)
    if len(names) != n:
        raise SetGraphError("names and matrix differ in length")
    kind = _id_type(names)
    known = cells.sparkSession.createDataFrame(list(enumerate(_as_ids(names, kind))), f"_at long, _name {kind}")
    return cells.join(known, cells[column] == F.col("_at")).withColumn(column, F.col("_name")).drop("_at", "_name")


def from_numpy_array(spark: SparkSession, matrix, node_names: Sequence | None = None, edge_names: Sequence | None = None, name: str | None = None, key: Callable[[Column], Column] | None = None) -> HGraph:
    """From a matrix of nodes by edges, dense or sparse; names default to v0, v1, ... and e0, e1, ... Rows and columns of 0s vanish.

    Sparse is what has tocoo(), or row, col, data and shape; key is asked for its stored cells only.
    """
    cells, (n, m) = _cells(spark, matrix, key is not None)
    return from_long_matrix(_named(_named(cells, "i", node_names, n, "v"), "j", edge_names, m, "e"), key=key, name=name)


def from_incidence_matrix(spark: SparkSession, matrix, name: str | None = None) -> HGraph:
    """From a matrix of nodes by edges, dense or sparse, ids being places."""
    return from_long_matrix(_cells(spark, matrix)[0], name=name)


def from_incidence_dataframe(df: DataFrame, node_col: str | None = None, fillna: float = 0, key: Callable[[Column], Column] | None = None, name: str | None = None, return_only_dataframe: bool = False) -> HGraph | DataFrame:
    """From a wide table: a row a node (its id in node_col, by default the first column), a column an edge."""
    node = node_col or df.columns[0]
    edges = [c for c in df.columns if c != node]
    doubled = df.select(F.col(f"`{node}`").alias("node"), *(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(fillna))).alias(c) for c in edges))
    long = doubled.unpivot(["node"], edges, "edge", "weight")
    long = long.filter(key(F.col("weight")) if key else F.col("weight") != 0)
    return long if return_only_dataframe else HGraph.from_dataframe(long, "edge", "node", name=name)
