"""The hypergraph: one table of incidences, and tables of edge and node properties."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import SetGraphError
from .functions.properties import STRINGS, decode_value, flatten, no_properties, upsert
from .sources.normalise import normalise

EDGES, NODES, INCIDENCES = 0, 1, 2
SIDES = {EDGES: ("edge", "node"), NODES: ("node", "edge")}


def side(level: int) -> tuple[str, str]:
    """The id column of a level and the opposite one."""
    if level not in SIDES:
        raise SetGraphError("level has to be 0 (edges) or 1 (nodes)")
    return SIDES[level]


def id_table(spark: SparkSession, ids: Iterable | DataFrame, kind, name: str) -> DataFrame:
    """Ids as a one-column table of distinct values."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast(kind).alias(name)).distinct()
    return spark.createDataFrame([(x,) for x in dict.fromkeys(ids)], f"{name} {kind.simpleString()}")


@dataclass(frozen=True)
class Properties:
    """A property table and defaults. Keys are uid, or edge and node. Changes give a new table."""

    table: DataFrame
    keys: tuple[str, ...] = ("uid",)
    defaults: Mapping[str, object] = field(default_factory=lambda: {"weight": 1.0})

    @staticmethod
    def empty(spark: SparkSession, kind, default_weight: float = 1.0) -> Properties:
        return Properties(spark.createDataFrame([], f"uid {kind.simpleString()}, weight double, misc map<string,string>"), defaults={"weight": default_weight})

    @property
    def columns(self) -> list[str]:
        """Named property columns besides weight and misc."""
        return [c for c in self.table.columns if c not in (*self.keys, "weight", "misc")]

    def _at(self, uid) -> Column:
        values = uid if len(self.keys) > 1 else (uid,)
        found = F.lit(True)
        for key, value in zip(self.keys, values, strict=True):
            found = found & (F.col(key) == F.lit(value))
        return found

    def row(self, uid) -> dict | None:
        """The stored properties of an id, misc decoded; None if it has none."""
        rows = self.table.filter(self._at(uid)).limit(1).collect()
        if not rows:
            return None
        values = {k: v for k, v in rows[0].asDict().items() if k not in self.keys}
        values["misc"] = {k: decode_value(v) for k, v in (values.get("misc") or {}).items()}
        return values

    def get_properties(self, uid) -> dict:
        """All properties of an id on one level; the defaults for an unknown id."""
        found = self.row(uid)
        return flatten(found) if found is not None else dict(self.defaults)

    def get_property(self, uid, name: str):
        """One property; the default for an unknown id, None for an unknown property, misc as it is stored."""
        found = self.row(uid)
        if found is None:
            return self.defaults.get(name)
        return found[name] if name in found else flatten(found["misc"]).get(name)

    def __getitem__(self, uid) -> dict:
        return self.get_properties(uid)

    def __contains__(self, uid) -> bool:
        return bool(self.table.filter(self._at(uid)).limit(1).collect())

    def set_properties(self, uid, values: Mapping[str, object]) -> Properties:
        return self.upsert([(uid, values)])

    def set_property(self, uid, name: str, value) -> Properties:
        return self.upsert([(uid, {name: value})])

    def upsert(self, edits: Iterable[tuple[object, Mapping[str, object]]]) -> Properties:
        """Many edits at once: a value replaces that of the column of its name, or the misc entry; new ids get rows."""
        merged: dict = {}
        for uid, values in edits:
            merged.setdefault(uid, {}).update(values)
        if not merged:
            return self
        named = ["weight", *self.columns]
        kinds = {f.name: f.dataType.simpleString() for f in self.table.schema}
        rows = []
        for uid, values in merged.items():
            key = uid if len(self.keys) > 1 else (uid,)
            inner = dict(values.get("misc") or {}) | {k: v for k, v in values.items() if k not in (*named, "misc")}
            texts = {k: v for k, v in ((k, _text(v)) for k, v in inner.items())}
            rows.append((*key, *(_typed(values.get(c), kinds[c]) for c in named), *(c in values for c in named), texts))
        schema = [f"{k} {kinds[k]}" for k in self.keys] + [f"`_new_{c}` {kinds[c]}" for c in named] + [f"`_has_{c}` boolean" for c in named] + ["_misc map<string,string>"]
        new = self.table.sparkSession.createDataFrame(rows, ", ".join(schema)).withColumn("_edit", F.lit(True))
        both = self.table.withColumn("_old", F.lit(True)).join(new, list(self.keys), "full_outer")
        value = {}
        for c in named:
            default = F.when(F.col("_old").isNull(), F.lit(self.defaults.get(c)).cast(kinds[c]))
            value[c] = F.when(F.coalesce(F.col(f"_has_{c}"), F.lit(False)), F.col(f"_new_{c}")).otherwise(F.coalesce(F.col(c), default))
        old, extra = F.coalesce("misc", no_properties()), F.coalesce("_misc", no_properties())
        misc = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra)
        return replace(self, table=both.select(*self.keys, *(value[c].alias(c) for c in named), misc.alias("misc")).select(*self.table.columns))

    def set_defaults(self, defaults: Mapping[str, object]) -> Properties:
        """New defaults. A name without a column becomes one, taken from misc; nulls in a column are filled."""
        table = self.table
        for name, value in defaults.items():
            if name in table.columns:
                table = table.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(table.schema[name].dataType)))
            else:
                kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")
                table = table.withColumn(name, F.coalesce(F.try_element_at("misc", F.lit(name)).cast(kind), F.lit(_text(value)).cast(kind)))
                table = table.withColumn("misc", _without(F.col("misc"), name))
        return replace(self, table=table, defaults={**self.defaults, **defaults})

    def copy(self) -> Properties:
        return self


def _without(entries: Column, name: str) -> Column:
    return F.map_filter(entries, lambda k, v: k != name)


def _text(value):
    from .functions.properties import encode_value

    return encode_value(value)


def _typed(value, kind: str):
    return float(value) if kind == "double" and value is not None else value


@dataclass(frozen=True)
class View:
    """The edges, nodes or incidences of a hypergraph. Only ids that occur in an incidence are visible."""

    graph: HGraph
    level: int

    @property
    def keys(self) -> tuple[str, ...]:
        return ("edge", "node") if self.level == INCIDENCES else (SIDES[self.level][0],)

    @property
    def property_table(self) -> Properties:
        g = self.graph
        return (g.edge_properties, g.node_properties, Properties(g.incidences, ("edge", "node"), {"weight": g.default_cell_weight}))[self.level]

    @property
    def default_weight(self) -> float:
        return self.property_table.defaults["weight"]

    @cached_property
    def items(self) -> DataFrame:
        """Distinct visible ids (pairs for incidences)."""
        return self.graph.incidences.select(*self.keys).distinct()

    def dataframe(self) -> DataFrame:
        """Visible ids with their properties, defaults where there are none."""
        if self.level == INCIDENCES:
            return self.graph.incidences
        props = self.property_table
        out = self.items.withColumnRenamed(self.keys[0], "uid").join(props.table, "uid", "left")
        filled = {c: F.coalesce(F.col(c), F.lit(props.defaults[c]).cast(out.schema[c].dataType)) for c in props.defaults if c in out.columns}
        return out.withColumns(filled | {"misc": F.coalesce("misc", no_properties())})

    to_dataframe = properties = dataframe

    def user_defined_properties(self) -> DataFrame:
        """Stored rows, those of invisible ids included."""
        return self.property_table.table

    def memberships(self) -> DataFrame:
        """node, edges: the sorted edges of each node."""
        return self.graph.memberships()

    def elements(self) -> DataFrame:
        """edge, nodes: the sorted nodes of each edge."""
        return self.graph.elements()

    incidence_dict = elements

    def is_empty(self) -> bool:
        return self.graph.incidences.isEmpty()

    def __iter__(self) -> Iterator:
        rows = self.items.orderBy(*self.keys).toLocalIterator()
        return (tuple(r) for r in rows) if self.level == INCIDENCES else (r[0] for r in rows)

    def __call__(self) -> Iterator:
        return iter(self)

    def __len__(self) -> int:
        return self.items.count()

    def _found(self, uid) -> DataFrame:
        values = uid if self.level == INCIDENCES else (uid,)
        if len(values) != len(self.keys):
            raise SetGraphError("an incidence is a pair of edge and node")
        out = self.graph.incidences
        for key, value in zip(self.keys, values, strict=True):
            out = out.filter(F.col(key) == F.lit(value))
        return out

    def __contains__(self, uid) -> bool:
        return bool(self._found(uid).limit(1).collect())

    def __getitem__(self, uid) -> Member | None:
        """The ids that an id is incident to, with its properties as attributes; None if it isn't visible."""
        if self.level == INCIDENCES:
            return Member(self, uid, list(uid)) if uid in self else None
        _, other = side(self.level)
        ids = sorted(r[0] for r in self._found(uid).select(other).distinct().collect())
        return Member(self, uid, ids) if ids else None

    def set_defaults(self, defaults: Mapping[str, object]) -> HGraph:
        """The graph with other defaults for this view."""
        changed = self.property_table.set_defaults(defaults)
        if self.level == EDGES:
            return replace(self.graph, edge_properties=changed)
        if self.level == NODES:
            return replace(self.graph, node_properties=changed)
        return replace(self.graph, incidences=changed.table, default_cell_weight=changed.defaults["weight"])


class Member(list):
    """The incident ids of one id; its properties are attributes, reading never writes."""

    def __init__(self, view: View, uid, ids: list):
        super().__init__(ids)
        self._view, self.uid = view, uid

    @cached_property
    def properties(self) -> dict:
        return self._view.property_table.get_properties(self.uid)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in ("memberships", "elements"):
            return list(self)
        return self.properties.get(name)


@dataclass(frozen=True, eq=False)
class HGraph:
    """An immutable hypergraph. Every operation is a transformation of its DataFrames."""

    incidences: DataFrame
    edge_properties: Properties
    node_properties: Properties
    default_cell_weight: float = 1.0
    name: str | None = None

    # -- construction -------------------------------------------------------------------------------------------

    @staticmethod
    def from_dataframe(
        df: DataFrame,
        edge_col: str | int = 0,
        node_col: str | int = 1,
        cell_weight_col: str | None = "weight",
        misc_cell_properties_col: str | None = None,
        default_cell_weight: float = 1.0,
        aggregate_by: str | Callable | Mapping[str, str | Callable] = "first",
        order_col: str | None = None,
        name: str | None = None,
        **properties,
    ) -> HGraph:
        """From a table with a row for each incidence; see with_properties for `properties`."""
        edge, node = (df.columns[c] if isinstance(c, int) else c for c in (edge_col, node_col))
        table = normalise(df, {"edge": edge, "node": node}, cell_weight_col, default_cell_weight, misc_cell_properties_col, aggregate_by, order_col)
        return HGraph.of(table, default_cell_weight, name).with_properties(**properties)

    @staticmethod
    def of(incidences: DataFrame, default_cell_weight: float = 1.0, name: str | None = None) -> HGraph:
        """From a normalised incidence table (edge, node, weight, misc, ...)."""
        spark, kinds = incidences.sparkSession, incidences.schema
        return HGraph(incidences, Properties.empty(spark, kinds["edge"].dataType), Properties.empty(spark, kinds["node"].dataType), default_cell_weight, name)

    def with_properties(
        self,
        properties: DataFrame | Mapping | None = None,
        misc_properties_col: str | None = None,
        weight_prop_col: str = "weight",
        default_weight: float = 1.0,
        edge_properties: DataFrame | Mapping | None = None,
        misc_edge_properties_col: str | None = None,
        edge_weight_prop_col: str = "weight",
        default_edge_weight: float = 1.0,
        node_properties: DataFrame | Mapping | None = None,
        misc_node_properties_col: str | None = None,
        node_weight_prop_col: str = "weight",
        default_node_weight: float = 1.0,
        uid_col: str | None = None,
    ) -> HGraph:
        """The graph with property tables (the id is uid_col or the first column) or mappings of ids to values.

        `properties` serves edges and nodes alike, from one table.
        """
        spark = self.incidences.sparkSession

        def read(given, kind, misc, weight, default) -> Properties:
            if given is None:
                return replace(Properties.empty(spark, kind), defaults={"weight": float(default)})
            if isinstance(given, Mapping):
                rows = [(k, v if isinstance(v, Mapping) else {"weight": v}) for k, v in given.items()]
                return replace(Properties.empty(spark, kind, float(default)), defaults={"weight": float(default)}).upsert([(k, {("weight" if n == weight else n): x for n, x in v.items()}) for k, v in rows])
            if isinstance(given, DataFrame):
                table = normalise(given, {"uid": uid_col or given.columns[0]}, weight, default, misc)
                return Properties(table.withColumn("uid", F.col("uid").cast(kind)), defaults={"weight": float(default)})
            raise SetGraphError(f"properties can't be a {type(given).__name__}")

        edge_kind, node_kind = (self.incidences.schema[c].dataType for c in ("edge", "node"))
        if properties is not None:
            shared = (properties, misc_properties_col, weight_prop_col, default_weight)
            return replace(self, edge_properties=read(shared[0], edge_kind, *shared[1:]), node_properties=read(shared[0], node_kind, *shared[1:]))
        return replace(
            self,
            edge_properties=read(edge_properties, edge_kind, misc_edge_properties_col, edge_weight_prop_col, default_edge_weight),
            node_properties=read(node_properties, node_kind, misc_node_properties_col, node_weight_prop_col, default_node_weight),
        )

    # -- access -------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.incidences.sparkSession

    @property
    def edges(self) -> View:
        return View(self, EDGES)

    @property
    def nodes(self) -> View:
        return View(self, NODES)

    @property
    def cells(self) -> View:
        """The incidences as a view; the table is `incidences`."""
        return View(self, INCIDENCES)

    @cached_property
    def pairs(self) -> DataFrame:
        """edge, node."""
        return self.incidences.select("edge", "node")

    def dataframe(self) -> DataFrame:
        return self.incidences

    properties = dataframe

    def persist(self) -> HGraph:
        """Keep the incidences in memory and on disk, for graphs that many operations read."""
        self.incidences.persist()
        return self

    def elements(self) -> DataFrame:
        return self.incidences.groupBy("edge").agg(F.array_sort(F.collect_set("node")).alias("nodes"))

    def memberships(self) -> DataFrame:
        return self.incidences.groupBy("node").agg(F.array_sort(F.collect_set("edge")).alias("edges"))

    incidence_dict = elements

    def neighbors_of(self, level: int, key) -> DataFrame:
        """The nodes of an edge (level 0) or the edges of a node (1); empty for other levels."""
        if level not in SIDES:
            return self.incidences.select("node").limit(0)
        own, other = SIDES[level]
        return self.incidences.filter(F.col(own) == F.lit(key)).select(other).distinct()

    def dimensions(self) -> tuple[int, int]:
        """Numbers of edges and of nodes."""
        row = self.incidences.agg(F.countDistinct("edge"), F.countDistinct("node")).first()
        return row[0], row[1]

    @property
    def shape(self) -> tuple[int, int]:
        """Numbers of nodes and of edges."""
        return self.dimensions()[::-1]

    def order(self) -> int:
        return self.incidences.select(F.countDistinct("node")).first()[0]

    def __len__(self) -> int:
        return self.order()

    def __iter__(self) -> Iterator:
        return iter(self.nodes)

    def __contains__(self, node) -> bool:
        return node in self.nodes

    def __getitem__(self, node) -> list:
        return self.neighbors(node)

    def __str__(self) -> str:
        return f"{self.name or 'unnamed'}, {type(self).__name__}"

    __repr__ = __str__

    def __eq__(self, other) -> bool:
        """The same incidence pairs; properties don't count."""
        if not isinstance(other, HGraph):
            return NotImplemented
        a, b = self.pairs.withColumn("_side", F.lit(1)), other.pairs.withColumn("_side", F.lit(2))
        odd = a.unionByName(b).groupBy("edge", "node").agg(F.countDistinct("_side").alias("n")).filter("n < 2")
        return odd.isEmpty()

    __hash__ = None

    def clone(self, name: str | None = None) -> HGraph:
        return replace(self, name=name or self.name)

    def get_cell_properties(self, edge, node, name: str | None = None):
        found = self.cells.property_table
        return found.get_property((edge, node), name) if name else found.get_properties((edge, node))

    def get_properties(self, uid, level: int = EDGES, name: str | None = None):
        found = View(self, level).property_table
        return found.get_property(uid, name) if name else found.get_properties(uid)

    # -- sizes and degrees --------------------------------------------------------------------------------------

    def edge_sizes(self) -> DataFrame:
        """edge, size."""
        return self.incidences.groupBy("edge").agg(F.count("*").alias("size"))

    def node_degrees(self, s: int = 1, max_size: int | None = None) -> DataFrame:
        """node, degree: how many of its edges have a size from s to max_size, 0 included."""
        if s <= 1 and max_size is None:
            return self.incidences.groupBy("node").agg(F.count("*").alias("degree"))
        fits = F.col("size") >= s if max_size is None else F.col("size").between(s, max_size)
        sized = self.pairs.join(self.edge_sizes(), "edge")
        return sized.groupBy("node").agg(F.count(F.when(fits, 1)).alias("degree"))

    def size(self, edge, nodeset: Iterable | None = None) -> int:
        own = self.incidences.filter(F.col("edge") == F.lit(edge))
        if nodeset is not None:
            own = own.join(id_table(self.spark, nodeset, self.incidences.schema["node"].dataType, "node"), "node", "left_semi")
        return own.count()

    def dim(self, edge) -> int:
        return self.size(edge) - 1

    def degree(self, node, s: int = 1, max_size: int | None = None) -> int:
        own = self.pairs.filter(F.col("node") == F.lit(node)).select("edge")
        if s <= 1 and max_size is None:
            return own.count()
        sizes = self.incidences.join(own, "edge", "left_semi").groupBy("edge").agg(F.count("*").alias("size"))
        return sizes.filter(F.col("size") >= s if max_size is None else F.col("size").between(s, max_size)).count()

    def edge_size_dist(self) -> list[int]:
        """Sizes in the order of the edges' ids."""
        return [r["size"] for r in self.edge_sizes().orderBy("edge").toLocalIterator()]


def _delegate(module: str, names: Iterable[str]) -> None:
    """Methods that are functions of an operator module with the graph as first parameter."""
    import importlib

    for name in names:

        def method(self, *args, _name=name, **kwargs):
            return getattr(importlib.import_module(f"setgraph.operators.{module}"), _name)(self, *args, **kwargs)

        method.__name__, method.__doc__ = name, f"See setgraph.operators.{module}.{name}."
        setattr(HGraph, name, method)


_delegate(
    "transforms",
    """dual restrict_to_nodes restrict_to_edges restrict_to remove_edges remove_nodes remove_incidences rename equivalence_classes
    collapse_edges collapse_nodes collapse_nodes_and_edges singletons remove_singletons add_edge add_edges_from add_node add_nodes_from
    add_incidence add_incidences_from add_nodes_to_edges sum union difference intersection""".split(),
)
_delegate(
    "pairs",
    """neighbors edge_neighbors adjacency_matrix edge_adjacency_matrix auxiliary_matrix get_linegraph toplexes toplex_graph
    incidence_matrix incidence_dataframe bipartite containment""".split(),
)
_delegate(
    "connectivity",
    """is_connected s_connected_components s_components connected_components components s_component_subgraphs
    connected_component_subgraphs component_subgraphs node_diameters edge_diameters diameter edge_diameter distance edge_distance""".split(),
)
HGraph.__add__ = lambda self, other: self.sum(other)
HGraph.__sub__ = lambda self, other: self.difference(other)

Predicate = Callable[[Column], Column]
__all__ = ["EDGES", "INCIDENCES", "NODES", "STRINGS", "HGraph", "Member", "Predicate", "Properties", "View", "upsert"]
