"""Queries on the test tables: each operator applied to a whole hypergraph, with the same result in DuckDB's SQL.

Graphs: order_part (edges are orders, nodes parts, weights summed quantities), part_supplier (edges are parts),
user_event (edges are users, nodes event types), order_line (edges are orders, nodes lines), nation_supplier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import properties as props
from .functions import rules
from .graph import HGraph
from .operators import centrality, communities, connectivity, epidemics, generators, homology, layout, matching, pairs, reports, transforms, walks
from .operators.transforms import class_map
from .plans.lineage import cut_lineage
from .plans.tasks import spread
from .sources import collections as build
from .sources import interchange

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = f"WITH RECURSIVE {_GRAPHS}\n{sql.strip()}" if not sql.lstrip().startswith(",") else f"WITH RECURSIVE {_GRAPHS}{sql.strip()}"
        return function

    return add


_GRAPHS = """inc AS (SELECT l_orderkey AS edge, l_partkey AS node, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
ps AS (SELECT l_partkey AS edge, l_suppkey AS node, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
ln AS (SELECT DISTINCT l_orderkey AS edge, l_orderkey * 8 + l_linenumber AS node FROM lineitem),
nat AS (SELECT DISTINCT s_nationkey AS edge, s_suppkey AS node FROM supplier),
ue AS (SELECT user_id AS edge, event_type AS node, count(*)::DOUBLE AS weight FROM events GROUP BY ALL),
sizes AS (SELECT edge, count(*) AS size FROM inc GROUP BY edge),
degrees AS (SELECT node, count(*) AS degree FROM inc GROUP BY node)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(rows: DataFrame, edge: str, node: str, weight: str | None) -> HGraph:
    """Incidences weighed by a summed column, or by the number of rows."""
    value = F.sum(weight) if weight else F.count("*")
    known = spread(rows.filter(F.col(edge).isNotNull() & F.col(node).isNotNull()), rows.count(), edge, node)
    cells = known.groupBy(F.col(edge).alias("edge"), F.col(node).alias("node")).agg(value.cast("double").alias("weight"))
    return HGraph.of(cells.withColumn("misc", props.no_properties()))


def order_part(spark: SparkSession, sf_dir: str) -> HGraph:
    return _graph(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")


def part_supplier(spark: SparkSession, sf_dir: str) -> HGraph:
    return _graph(_read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", None)


def user_event(spark: SparkSession, sf_dir: str) -> HGraph:
    return _graph(_read(spark, sf_dir, "events"), "user_id", "event_type", None)


def order_line(spark: SparkSession, sf_dir: str) -> HGraph:
    """Edges are orders, nodes their lines, each of which is in one order."""
    lines = _read(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return _graph(lines, "l_orderkey", "line", None)


def nation_supplier(spark: SparkSession, sf_dir: str) -> HGraph:
    """Edges are nations, nodes suppliers: a component for each nation."""
    return _graph(_read(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", None)


def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition of the parts by size modulo 5."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.pmod(F.col("p_size"), F.lit(5)).cast("int").alias("part"))


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# -- sizes, degrees, representations ------------------------------------------------------------------------------


@query("SELECT edge, size FROM sizes")
def size_dist(spark, sf_dir):
    return reports.edge_size_dist(order_part(spark, sf_dir)).select("edge", "size")


@query("SELECT size, count(*) AS n FROM sizes GROUP BY size")
def size_hist(spark, sf_dir):
    return reports.edge_size_dist(order_part(spark, sf_dir), aggregated=True)


@query("SELECT node, degree FROM degrees")
def degree_dist(spark, sf_dir):
    return reports.degree_dist(order_part(spark, sf_dir)).select("node", "degree")


@query("SELECT degree, count(*) AS n FROM degrees GROUP BY degree")
def degree_hist(spark, sf_dir):
    return reports.degree_dist(order_part(spark, sf_dir), aggregated=True)


@query("SELECT node, count(*) FILTER (size BETWEEN 2 AND 5) AS degree FROM inc JOIN sizes USING (edge) GROUP BY node")
def degree_s2_max5(spark, sf_dir):
    return order_part(spark, sf_dir).node_degrees(2, 5)


@query(
    """SELECT count(DISTINCT node) AS nrows, count(DISTINCT edge) AS ncols, round(count(DISTINCT node) / count(DISTINCT edge), 9) AS aspect_ratio,
    count(*) AS ncells, round(count(*) / (count(DISTINCT node)::DOUBLE * count(DISTINCT edge)), 9) AS density FROM inc"""
)
def info_row(spark, sf_dir):
    return reports.info_table(order_part(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("aspect_ratio", "density")})


@query("SELECT edge, node, weight FROM inc")
def incidence_list(spark, sf_dir):
    return order_part(spark, sf_dir).incidences.select("edge", "node", "weight")


@query("SELECT edge, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM inc GROUP BY edge")
def elements(spark, sf_dir):
    return order_part(spark, sf_dir).elements().select("edge", _joined("nodes").alias("nodes"))


@query("SELECT node, string_agg(edge::VARCHAR, ',' ORDER BY edge) AS edges FROM inc GROUP BY node")
def memberships(spark, sf_dir):
    return order_part(spark, sf_dir).memberships().select("node", _joined("edges").alias("edges"))


@query("SELECT node AS edge, degree AS size FROM degrees")
def dual_sizes(spark, sf_dir):
    return order_part(spark, sf_dir).dual().edge_sizes()


@query(
    """, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM degrees), e AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS j FROM sizes)
    SELECT i, j, weight AS value FROM inc JOIN n USING (node) JOIN e USING (edge)"""
)
def incidence_matrix(spark, sf_dir):
    return pairs.incidence_matrix(order_part(spark, sf_dir), weights=True)[0]


@query("SELECT * FROM (SELECT edge, node::VARCHAR AS node, weight FROM ue)")
def incidence_unpivot(spark, sf_dir):
    wide = user_event(spark, sf_dir).dual().incidence_dataframe(weights=True)
    back = build.from_incidence_dataframe(wide, return_only_dataframe=True)
    return back.select(F.col("node").cast("long").alias("edge"), F.col("edge").alias("node"), "weight")


@query("SELECT edge::VARCHAR AS id, 0 AS side FROM sizes UNION ALL SELECT node::VARCHAR, 1 FROM degrees")
def bipartite_vertices(spark, sf_dir):
    return order_part(spark, sf_dir).bipartite()[0]


@query("SELECT edge, node, weight, count(*) OVER (PARTITION BY edge) AS size FROM inc")
def interchange_records(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    records = interchange.to_records(graph)
    back = HGraph.from_dataframe(records["incidences"], "edge", "node", "weight", "attrs")
    return back.incidences.join(back.edge_sizes(), "edge").select("edge", "node", "weight", "size")


@query(
    """SELECT o_orderkey AS uid, coalesce(o_totalprice, 1)::DOUBLE AS weight, o_orderstatus AS status FROM orders JOIN sizes ON edge = o_orderkey"""
)
def edge_view(spark, sf_dir):
    stored = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_totalprice").cast("double").alias("weight"), F.col("o_orderstatus").alias("status"))
    graph = order_part(spark, sf_dir).with_properties(edge_properties=stored)
    known = graph.edges.dataframe().join(stored.select("uid"), "uid", "left_semi")
    return known.select("uid", "weight", "status")


# -- restriction, sets, collapse ----------------------------------------------------------------------------------


@query("SELECT edge, count(*) AS size FROM inc WHERE node % 7 = 0 GROUP BY edge")
def restrict_nodes(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    return graph.restrict_to_nodes(graph.pairs.filter("node % 7 = 0").select("node")).edge_sizes()


@query("SELECT node, count(*) AS degree FROM inc JOIN orders ON o_orderkey = edge WHERE o_orderstatus = 'F' GROUP BY node")
def restrict_edges(spark, sf_dir):
    chosen = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("edge"))
    return order_part(spark, sf_dir).restrict_to_edges(chosen).node_degrees()


@query("SELECT edge, count(*) AS size FROM inc JOIN degrees USING (node) WHERE degree <= 30 GROUP BY edge")
def remove_nodes(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    return graph.remove_nodes(graph.node_degrees().filter("degree > 30").select("node")).edge_sizes()


@query("SELECT edge, node FROM inc WHERE NOT ((edge + node) % 3 = 0)")
def remove_incidences(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    return graph.remove_incidences(graph.pairs.filter("(edge + node) % 3 = 0")).pairs


_SINGLE = ", single AS (SELECT min(edge) AS edge FROM ln WHERE edge IN (SELECT edge FROM ln GROUP BY edge HAVING count(*) = 1) GROUP BY node HAVING node IN (SELECT node FROM ln GROUP BY node HAVING count(*) = 1))"


@query(_SINGLE + " SELECT edge FROM single")
def singletons(spark, sf_dir):
    return order_line(spark, sf_dir).singletons()


@query(_SINGLE + " SELECT edge, node FROM ln WHERE edge NOT IN (SELECT edge FROM single)")
def remove_singletons(spark, sf_dir):
    return order_line(spark, sf_dir).remove_singletons().pairs


@query("SELECT edge, node FROM inc JOIN orders ON o_orderkey = edge WHERE o_orderstatus <> 'F'")
def remove_edges(spark, sf_dir):
    gone = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("edge"))
    return order_part(spark, sf_dir).remove_edges(gone).pairs


@query("SELECT o_orderkey AS uid, 1.0::DOUBLE AS weight FROM orders JOIN sizes ON edge = o_orderkey WHERE o_orderkey NOT BETWEEN 1 AND 3 UNION ALL SELECT edge, 2.5 FROM sizes WHERE edge BETWEEN 1 AND 3")
def add_edges(spark, sf_dir):
    """Property rows for three edges; an edge without an incidence stays unseen."""
    graph = order_part(spark, sf_dir).add_edges_from([(i, {"weight": 2.5}) for i in (1, 2, 3)]).add_edge(-1, weight=9.0)
    return graph.edges.dataframe().select("uid", "weight")


@query("SELECT node AS uid, CASE WHEN node BETWEEN 1 AND 3 THEN 2.5 ELSE 1.0 END::DOUBLE AS weight FROM degrees")
def add_nodes(spark, sf_dir):
    graph = order_part(spark, sf_dir).add_nodes_from([(i, {"weight": 2.5}) for i in (1, 2, 3)]).add_node(-1, weight=9.0)
    return graph.nodes.dataframe().select("uid", "weight")


@query("SELECT edge, node, weight FROM inc WHERE edge <> 1 OR node <> 1 UNION ALL SELECT 1, 1, 7.0 UNION ALL SELECT -1, 5, 1.0 UNION ALL SELECT -1, 6, 1.0")
def add_incidences(spark, sf_dir):
    """A new edge of two nodes, and one incidence with a weight."""
    graph = order_part(spark, sf_dir).add_incidence(1, 1, weight=7.0).add_nodes_to_edges({-1: [5, 6]})
    return graph.incidences.select("edge", "node", "weight")


@query("SELECT edge, node, weight FROM inc UNION ALL SELECT edge, -1 - node, 2.0 FROM sizes JOIN inc USING (edge) WHERE size = 1")
def add_incidence_table(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    single = graph.incidences.join(graph.edge_sizes().filter("size = 1"), "edge", "left_semi")
    more = single.select("edge", (-1 - F.col("node")).alias("node"), F.lit(2.0).alias("weight"), "misc")
    return graph.add_incidences_from(more).incidences.select("edge", "node", "weight")


_KEYS = ", k AS (SELECT edge, string_agg(node::VARCHAR, ',' ORDER BY node) AS key FROM inc GROUP BY edge)"


@query(_KEYS + " SELECT min(edge) AS rep, string_agg(edge::VARCHAR, ',' ORDER BY edge) AS members FROM k GROUP BY key")
def edge_classes(spark, sf_dir):
    return order_part(spark, sf_dir).equivalence_classes().select("rep", _joined("members").alias("members"))


@query(_KEYS + ", c AS (SELECT edge, min(edge) OVER (PARTITION BY key) AS rep FROM k) SELECT rep AS edge, node, sum(weight) AS weight FROM inc JOIN c USING (edge) GROUP BY rep, node")
def collapse_edges(spark, sf_dir):
    return order_part(spark, sf_dir).collapse_edges(return_counts=False).incidences.select("edge", "node", "weight")


@query(
    """, k AS (SELECT node, string_agg(edge::VARCHAR, ',' ORDER BY edge) AS key FROM ue GROUP BY node), c AS (SELECT node, min(node) OVER (PARTITION BY key) AS rep FROM k)
    SELECT edge, rep AS node, sum(weight) AS weight FROM ue JOIN c USING (node) GROUP BY ALL"""
)
def collapse_nodes(spark, sf_dir):
    return user_event(spark, sf_dir).collapse_nodes(return_counts=False).incidences.select("edge", "node", "weight")


def _spread(values):
    return values.max() - values.min()


@query(
    """, k AS (SELECT node, string_agg(edge::VARCHAR, ',' ORDER BY edge) AS key FROM ue GROUP BY node), c AS (SELECT node, min(node) OVER (PARTITION BY key) AS rep FROM k)
    SELECT edge, rep AS node, max(weight) - min(weight) AS weight FROM ue JOIN c USING (node) GROUP BY ALL"""
)
def collapse_nodes_callable(spark, sf_dir):
    graph = user_event(spark, sf_dir).collapse_nodes(return_counts=False, aggregate_cells_by={"weight": _spread})
    return graph.incidences.select("edge", "node", "weight")


@query(
    """, nk AS (SELECT node, string_agg(edge::VARCHAR, ',' ORDER BY edge) AS key FROM ue GROUP BY node), nc AS (SELECT node, min(node) OVER (PARTITION BY key) AS rep FROM nk),
    u AS (SELECT edge, rep AS node, sum(weight) AS weight FROM ue JOIN nc USING (node) GROUP BY ALL),
    ek AS (SELECT edge, string_agg(node, ',' ORDER BY node) AS key FROM u GROUP BY edge), ec AS (SELECT edge, min(edge) OVER (PARTITION BY key) AS rep FROM ek)
    SELECT rep AS edge, node, sum(weight) AS weight FROM u JOIN ec USING (edge) GROUP BY rep, node"""
)
def collapse_nodes_and_edges(spark, sf_dir):
    return user_event(spark, sf_dir).collapse_nodes_and_edges(return_counts=False).incidences.select("edge", "node", "weight")


@query("SELECT l_suppkey AS edge, l_returnflag AS node, round(quantile_cont(l_quantity::DOUBLE, 0.25), 6) AS weight FROM lineitem GROUP BY ALL")
def aggregate_by_callable(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    graph = HGraph.from_dataframe(rows.select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("double").alias("w")), "l_suppkey", "l_returnflag", "w", aggregate_by=lambda v: v.quantile(0.25))
    return graph.incidences.select("edge", "node", F.round("weight", 6).alias("weight"))


@query(", t AS (SELECT edge // 10 AS edge, node, edge AS was, weight FROM inc) SELECT edge, node, min_by(weight, was) AS weight FROM t GROUP BY ALL")
def rename_edges(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    mapping = graph.pairs.select(F.col("edge").alias("old"), F.expr("edge div 10").alias("new")).distinct()
    return graph.rename(edges=mapping).incidences.select("edge", "node", "weight")


def _halves(spark, sf_dir) -> tuple[HGraph, HGraph]:
    graph = order_part(spark, sf_dir)
    return tuple(HGraph.of(graph.incidences.filter(f"(edge + node) % 3 <> {r}")) for r in (0, 1))


@query("SELECT edge, node, weight FROM inc")
def union(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return a.union(b).incidences.select("edge", "node", "weight")


@query("SELECT edge, node FROM inc WHERE (edge + node) % 3 = 2")
def intersection(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return a.intersection(b).pairs


@query("SELECT edge, node FROM inc WHERE (edge + node) % 3 = 1")
def difference(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return a.difference(b).pairs


# -- pairs --------------------------------------------------------------------------------------------------------

_NODE_PAIRS = ", np AS (SELECT a.node AS src, b.node AS dst, count(*) AS overlap FROM inc a JOIN inc b ON a.edge = b.edge AND a.node < b.node GROUP BY ALL)"
_EDGE_PAIRS = ", ep AS (SELECT a.edge AS src, b.edge AS dst, count(*) AS overlap FROM inc a JOIN inc b ON a.node = b.node AND a.edge < b.edge GROUP BY ALL)"


@query(_NODE_PAIRS + ' SELECT src AS "row", dst AS col, 1 AS value FROM np UNION ALL SELECT dst, src, 1 FROM np')
def adjacency_s1(spark, sf_dir):
    return order_part(spark, sf_dir).adjacency_matrix(1)


@query(_NODE_PAIRS + ' SELECT src AS "row", dst AS col, 1 AS value FROM np WHERE overlap >= 2 UNION ALL SELECT dst, src, 1 FROM np WHERE overlap >= 2')
def adjacency_s2(spark, sf_dir):
    return order_part(spark, sf_dir).adjacency_matrix(2)


@query(_EDGE_PAIRS + ' SELECT src AS "row", dst AS col, 1 AS value FROM ep WHERE overlap >= 2 UNION ALL SELECT dst, src, 1 FROM ep WHERE overlap >= 2')
def edge_adjacency_s2(spark, sf_dir):
    return order_part(spark, sf_dir).edge_adjacency_matrix(2)


@query(_NODE_PAIRS + " SELECT DISTINCT unnest([src, dst]) AS id FROM np WHERE overlap >= 2")
def auxiliary_s2(spark, sf_dir):
    return order_part(spark, sf_dir).auxiliary_matrix(2)[0]


@query(_EDGE_PAIRS + ", l AS (SELECT unnest([src, dst]) AS id FROM ep WHERE overlap >= 2), d AS (SELECT id, count(*) AS n FROM l GROUP BY id) SELECT edge AS id, coalesce(n, 0) AS n FROM sizes LEFT JOIN d ON id = edge")
def linegraph_degree_s2(spark, sf_dir):
    vertices, links = order_part(spark, sf_dir).get_linegraph(2)
    degree = links.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return vertices.join(degree, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


_TOPLEXES = _EDGE_PAIRS + """, under AS (SELECT CASE WHEN a.size < b.size THEN src ELSE dst END AS edge FROM ep JOIN sizes a ON a.edge = src JOIN sizes b ON b.edge = dst WHERE overlap = least(a.size, b.size)),
top AS (SELECT edge FROM sizes WHERE edge NOT IN (SELECT edge FROM under))"""


@query(_TOPLEXES + " SELECT edge FROM top")
def toplexes(spark, sf_dir):
    return order_part(spark, sf_dir).toplexes()


@query(_TOPLEXES + " SELECT size, count(*) AS n FROM sizes JOIN top USING (edge) GROUP BY size")
def toplex_hist(spark, sf_dir):
    return reports.toplex_dist(order_part(spark, sf_dir), aggregated=True)


_INSIDE = _EDGE_PAIRS + """, within AS (SELECT CASE WHEN a.size <= b.size THEN src ELSE dst END AS src, CASE WHEN a.size <= b.size THEN dst ELSE src END AS dst
FROM ep JOIN sizes a ON a.edge = src JOIN sizes b ON b.edge = dst WHERE overlap = least(a.size, b.size))"""


@query(_INSIDE + " SELECT src, dst FROM within")
def containment_pairs(spark, sf_dir):
    return order_part(spark, sf_dir).containment(collapse=False)


@query(_INSIDE + ", up(edge, level) AS (SELECT edge, 0 FROM sizes UNION SELECT dst, level + 1 FROM up JOIN within ON src = edge) SELECT edge, max(level)::INTEGER AS level FROM up GROUP BY edge")
def set_layering(spark, sf_dir):
    return layout.set_layering(order_part(spark, sf_dir), collapse=False)


@query("SELECT DISTINCT b.node AS id FROM inc a JOIN inc b USING (edge) WHERE a.node = (SELECT min(node) FROM inc) AND b.node <> a.node")
def neighbors_one(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    least = graph.pairs.agg(F.min("node")).first()[0]
    return pairs.neighbor_table(graph, least).select(F.col("node").alias("id"))


@query("SELECT DISTINCT b.edge AS id FROM inc a JOIN inc b USING (node) WHERE a.edge = (SELECT min(edge) FROM inc) AND b.edge <> a.edge")
def edge_neighbors_one(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    least = graph.pairs.agg(F.min("edge")).first()[0]
    return pairs.neighbor_table(graph, least, level=0).select(F.col("edge").alias("id"))


@query("SELECT a.node AS src, b.node AS dst, round(sum(1.0 / (size - 1)), 6) AS weight FROM inc a JOIN inc b ON a.edge = b.edge AND a.node < b.node JOIN sizes s ON s.edge = a.edge GROUP BY ALL")
def two_section(spark, sf_dir):
    return communities.two_section(order_part(spark, sf_dir))[1].withColumn("weight", F.round("weight", 6))


# -- modularity, walks --------------------------------------------------------------------------------------------


def _modularity_sql(rule: str) -> str:
    return f""", p AS (SELECT p_partkey AS node, p_size % 5 AS part FROM part),
c AS (SELECT edge, part, count(*) AS c FROM inc JOIN p USING (node) GROUP BY ALL), e AS (SELECT edge, sum(c)::BIGINT AS d, max(c) AS c FROM c GROUP BY edge),
v AS (SELECT part, sum(c) / (SELECT sum(c) FROM c) AS p FROM c GROUP BY part), nd AS (SELECT d, count(*) AS n FROM e GROUP BY d),
f AS (SELECT d, n, unnest(range(d // 2 + 1, d + 1)) AS c FROM nd),
tax AS (SELECT sum(n * ({rule}) * exp(lgamma(d + 1) - lgamma(c + 1) - lgamma(d - c + 1) + c * ln(p) + (d - c) * ln(1 - p))) AS x FROM f, v),
inside AS (SELECT sum(CASE WHEN c > d / 2 THEN {rule} ELSE 0 END) AS x FROM e)
SELECT round((inside.x - tax.x) / (SELECT count(*) FROM e), 6) AS q FROM inside, tax"""


def _modularity(rule):
    def run(spark, sf_dir):
        q = communities.modularity(order_part(spark, sf_dir), part_classes(spark, sf_dir), rule)
        return spark.createDataFrame([(q,)], "q double").select(F.round("q", 6).alias("q"))

    run.__name__ = f"modularity_{rule.__name__}"
    return run


for _rule, _sql in ((rules.linear, "c / d::DOUBLE"), (rules.majority, "1.0"), (rules.strict, "CASE WHEN c = d THEN 1.0 ELSE 0.0 END")):
    query(_modularity_sql(_sql))(_modularity(_rule))


@query(
    """, e AS (SELECT edge, count(*) AS size, count(*) FILTER (p_size % 5 = 0) AS inside FROM inc JOIN part ON p_partkey = node GROUP BY edge)
    SELECT sum(CASE WHEN inside > 0 AND inside < size THEN size ELSE 0 END)::BIGINT AS cut, sum(inside)::BIGINT AS volume, sum(size - inside)::BIGINT AS outside FROM e"""
)
def conductance(spark, sf_dir):
    chosen = part_classes(spark, sf_dir).filter("part = 0").select("node")
    return communities.conductance_row(order_part(spark, sf_dir), chosen)


def _walk_sql(gamma: str) -> str:
    return f""", t AS (SELECT edge, node, {gamma} AS g FROM inc), e AS (SELECT edge, 1 + stddev_pop(g) AS w, sum(g) AS total FROM t GROUP BY edge),
l AS (SELECT node, sum(w) AS w FROM t JOIN e USING (edge) GROUP BY node)
SELECT a.node AS src, b.node AS dst, round(sum(e.w / l.w * b.g / total), 6) AS p FROM t a JOIN e USING (edge) JOIN l ON l.node = a.node JOIN t b ON b.edge = a.edge GROUP BY ALL"""


@query(_walk_sql("1.0::DOUBLE"))
def prob_trans(spark, sf_dir):
    return walks.prob_trans(order_part(spark, sf_dir), check_connected=False).withColumn("p", F.round("p", 6))


@query(_walk_sql("weight"))
def prob_trans_weighted(spark, sf_dir):
    return walks.prob_trans(order_part(spark, sf_dir), weights=True, check_connected=False).withColumn("p", F.round("p", 6))


@query("SELECT node AS id, round(degree / (SELECT count(*) FROM inc), 9) AS pi FROM degrees")
def stationary_closed_form(spark, sf_dir):
    return walks.stationary(order_part(spark, sf_dir)).withColumn("pi", F.round("pi", 9))


@query("SELECT node AS id, round(count(*) / (SELECT count(*) FROM ue), 6) AS pi FROM ue GROUP BY node")
def get_pi(spark, sf_dir):
    """By power iteration; it has a closed form for the walk without weights."""
    graph = user_event(spark, sf_dir)
    return walks.get_pi(walks.prob_trans(graph)).withColumn("pi", F.round("pi", 6))


@query("SELECT 'edge_size' AS what, size AS value, count(*) AS n FROM sizes GROUP BY size UNION ALL SELECT 'degree', degree, count(*) FROM degrees GROUP BY degree")
def dist_stats(spark, sf_dir):
    found = reports.dist_stats(order_part(spark, sf_dir), lists=False)
    rows = [(what, value, n) for what in ("edge_size", "degree") for value, n in found[f"{what}_hist"].items()]
    return spark.createDataFrame(rows, "what string, value long, n long")


@query("SELECT min(degree)::DOUBLE AS least, max(degree)::DOUBLE AS most, round(avg(degree), 6) AS mean, median(degree)::DOUBLE AS middle, round(stddev_pop(degree), 6) AS spread FROM degrees")
def centrality_stats(spark, sf_dir):
    row = reports.centrality_stats(order_part(spark, sf_dir).node_degrees(), "degree")
    found = spark.createDataFrame([tuple(row)], "least double, most double, mean double, middle double, spread double")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "spread")})


@query("SELECT count(*) AS n, min(size) - 1 AS least, max(size) - 1 AS most FROM sizes")
def dims(spark, sf_dir):
    return order_part(spark, sf_dir).edge_sizes().agg(F.count("*").alias("n"), (F.min("size") - 1).alias("least"), (F.max("size") - 1).alias("most"))


@query("SELECT (SELECT count(*) FROM sizes) AS edges, (SELECT count(*) FROM degrees) AS nodes")
def dimensions(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    return spark.createDataFrame([(graph.dimensions()[0], graph.order())], "edges long, nodes long")


@query("SELECT edge, node, weight FROM ue")
def hif_round_trip(spark, sf_dir):
    """To the interchange document and back."""
    return interchange.from_hif(spark, interchange.to_hif(user_event(spark, sf_dir))).incidences.select("edge", "node", "weight")


@query("SELECT edge, node FROM inc")
def bipartite_round_trip(spark, sf_dir):
    """To a bipartite graph and back."""
    vertices, links = order_part(spark, sf_dir).bipartite()
    vertices = vertices.select(F.concat_ws(":", "side", "id").alias("id"), F.col("side").alias("bipartite"))
    named = links.select(F.concat(F.lit("0:"), F.col("edge").cast("string")).alias("src"), F.concat(F.lit("1:"), F.col("node").cast("string")).alias("dst"))
    back = build.from_bipartite(vertices, named)
    return back.pairs.select(*(F.substring_index(c, ":", -1).cast("long").alias(c) for c in ("edge", "node")))


@query("SELECT edge, node FROM ue")
def dict_round_trip(spark, sf_dir):
    """To a dict of lists and back, the constructor choosing by kind."""
    lists = {r["edge"]: r["nodes"] for r in user_event(spark, sf_dir).elements().collect()}
    return build.hypergraph(spark, lists).pairs


@query("SELECT edge, node, weight FROM inc")
def matrix_round_trip(spark, sf_dir):
    """To a matrix in long form and back."""
    graph = order_part(spark, sf_dir)
    cells, nodes, edges = pairs.incidence_matrix(graph, weights=True)
    back = build.from_long_matrix(cells).incidences.select(F.col("edge").alias("j"), F.col("node").alias("i"), "weight")
    return back.join(nodes.withColumnRenamed("idx", "i"), "i").join(edges.withColumnRenamed("idx", "j"), "j").select("edge", "node", "weight")


@query(
    """, o AS (SELECT a.node AS "row", b.node AS col, -sum(1.0 / (size * sqrt(da.degree * db.degree))) AS v FROM inc a JOIN inc b ON a.edge = b.edge JOIN sizes s ON s.edge = a.edge
    JOIN degrees da ON da.node = a.node JOIN degrees db ON db.node = b.node GROUP BY ALL)
    SELECT "row", col, round(v + CASE WHEN "row" = col THEN 1 ELSE 0 END, 6) AS value FROM o WHERE abs(v + CASE WHEN "row" = col THEN 1 ELSE 0 END) > 1e-15"""
)
def norm_lap(spark, sf_dir):
    return walks.norm_lap(order_part(spark, sf_dir), check_connected=False).withColumn("value", F.round("value", 6))


# -- homology, rows, rules ----------------------------------------------------------------------------------------

_CELLS = """, so AS (SELECT edge, node FROM inc), c1 AS (SELECT DISTINCT a.node AS x, b.node AS y FROM so a JOIN so b ON a.edge = b.edge AND a.node < b.node),
c2 AS (SELECT DISTINCT a.node AS x, b.node AS y, c.node AS z FROM so a JOIN so b ON a.edge = b.edge AND a.node < b.node JOIN so c ON c.edge = a.edge AND b.node < c.node),
i1 AS (SELECT *, row_number() OVER (ORDER BY x, y) - 1 AS idx FROM c1), i2 AS (SELECT *, row_number() OVER (ORDER BY x, y, z) - 1 AS idx FROM c2),
b2 AS (SELECT i1.idx AS "row", i2.idx AS col FROM i2 JOIN i1 ON i1.x = i2.x AND i1.y = i2.y UNION ALL SELECT i1.idx, i2.idx FROM i2 JOIN i1 ON i1.x = i2.x AND i1.y = i2.z UNION ALL SELECT i1.idx, i2.idx FROM i2 JOIN i1 ON i1.x = i2.y AND i1.y = i2.z)"""


@query(_CELLS + " SELECT x || ',' || y AS cell FROM c1")
def kchains_1(spark, sf_dir):
    return homology.kchainbasis(order_part(spark, sf_dir), 1).select(_joined("cell").alias("cell"))


@query(_CELLS + " SELECT x || ',' || y || ',' || z AS cell FROM c2")
def kchains_2(spark, sf_dir):
    return homology.kchainbasis(order_part(spark, sf_dir), 2).select(_joined("cell").alias("cell"))


def _boundary(spark, sf_dir, k: int) -> DataFrame:
    return homology.boundary_matrix(order_part(spark, sf_dir), k)


@query(_CELLS + ' SELECT "row", col FROM b2')
def boundary_2(spark, sf_dir):
    return _boundary(spark, sf_dir, 2)


@query(_CELLS + ' SELECT a.col AS "row", b.col AS col FROM b2 a JOIN b2 b ON a."row" = b."row" GROUP BY ALL HAVING count(*) % 2 = 1')
def z2_matmul(spark, sf_dir):
    d = _boundary(spark, sf_dir, 2)
    return homology.logical_matmul_table(d.select(F.col("col").alias("row"), F.col("row").alias("col")), d)


@query(_CELLS + ' SELECT "row", col FROM (SELECT "row", col FROM b2 UNION ALL SELECT "row", col + 1 FROM b2) GROUP BY ALL HAVING count(*) % 2 = 1')
def z2_matadd(spark, sf_dir):
    d = _boundary(spark, sf_dir, 2)
    return homology.logical_matadd_table(d, d.select("row", (F.col("col") + 1).alias("col")))


def _rows(rule: str) -> None:
    function = {"mean": "avg", "sum": "sum", "count": "count", "median": "median", "max": "max", "min": "min"}[rule]
    kind = "BIGINT" if rule == "count" else "DOUBLE"

    def run(spark, sf_dir):
        rows = _read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("w"))
        return props.distinct_rows(rows, "w", rule).withColumn("w", F.round("w", 6) if rule != "count" else F.col("w"))

    run.__name__ = f"row_duplicates_{rule}"
    value = f"{function}(l_quantity)::{kind}" if rule == "count" else f"round({function}(l_quantity::DOUBLE), 6)"
    query(f"SELECT l_returnflag, l_linestatus, {value} AS w FROM lineitem GROUP BY ALL")(run)


for _name in ("sum", "count", "mean", "median", "max", "min"):
    _rows(_name)


@query("SELECT l_suppkey AS value, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS keys FROM lineitem GROUP BY l_suppkey")
def reverse_map(spark, sf_dir):
    lists = _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.collect_set("l_suppkey").alias("values"))
    return props.reversed_map(lists, "l_returnflag", "values").select("value", _joined("keys").alias("keys"))


def _step(rule, condition: str) -> None:
    def run(spark, sf_dir):
        graph = order_part(spark, sf_dir)
        status = graph.pairs.select("node").distinct().withColumn("status", F.when(F.col("node") % 4 == 0, "I").otherwise("S"))
        return epidemics.transmission(graph, status, rule).filter("force > 0").select("edge", "node")

    run.__name__ = f"contagion_step_{rule.__name__}"
    query(
        f""", e AS (SELECT edge, count(*) AS size, count(*) FILTER (node % 4 = 0) AS infected FROM inc GROUP BY edge)
        SELECT edge, node FROM inc JOIN e USING (edge) WHERE node % 4 <> 0 AND ({condition})"""
    )(run)


for _rule, _sql in ((rules.collective_contagion, "infected = size - 1"), (rules.individual_contagion, "infected >= 1"), (rules.threshold, "size > 1 AND infected / (size - 1) >= 0.1")):
    _step(_rule, _sql)


@query("SELECT edge AS id, round(avg(node), 6) AS position FROM inc GROUP BY edge")
def barycentre(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    positions = graph.pairs.select(F.col("node").alias("id"), F.col("node").cast("double").alias("position")).distinct()
    return layout.sort_left_by_right(graph, positions, level=0).withColumn("position", F.round("position", 6))


@query("SELECT edge, min(node)::DOUBLE AS low, max(node)::DOUBLE AS high FROM inc GROUP BY edge")
def extents(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    positions = graph.pairs.select(F.col("node").alias("id"), F.col("node").cast("double").alias("position")).distinct()
    return layout.extents(graph, positions)


@query(_KEYS + ", c AS (SELECT min(edge) AS rep, count(*) AS n FROM k GROUP BY key) SELECT rep, CASE WHEN n > 1 THEN rep || ' x ' || n ELSE rep::VARCHAR END AS label FROM c")
def class_labels(spark, sf_dir):
    return layout.create_labels(order_part(spark, sf_dir))


# -- components and distances -------------------------------------------------------------------------------------

_LINKS2 = _EDGE_PAIRS + ", l AS (SELECT src, dst FROM ep WHERE overlap >= 2 UNION ALL SELECT dst, src FROM ep WHERE overlap >= 2)"
_REACH2 = _LINKS2 + ", r(x, y) AS (SELECT edge, edge FROM sizes UNION SELECT x, dst FROM r JOIN l ON src = y), comp AS (SELECT x AS id, min(y) AS component FROM r GROUP BY x)"


@query("SELECT node AS id, min(node) OVER (PARTITION BY edge) AS component FROM nat")
def components_s1(spark, sf_dir):
    return connectivity.component_labels(nation_supplier(spark, sf_dir), 1, edges=False)


@query("SELECT node AS id, (SELECT min(node) FROM inc) AS component FROM degrees")
def components_s1_connected(spark, sf_dir):
    """The nodes of this graph are one component at every scale."""
    return connectivity.component_labels(order_part(spark, sf_dir), 1, edges=False)


@query("SELECT edge, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM nat GROUP BY edge")
def connected_components(spark, sf_dir):
    found = nation_supplier(spark, sf_dir).connected_components()
    nation = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("component"), F.col("s_nationkey").alias("edge"))
    return found.join(nation, "component").select("edge", _joined("members").alias("members"))


@query(", c AS (SELECT count(*) AS size FROM nat GROUP BY edge) SELECT size, count(*) AS n FROM c GROUP BY size")
def comp_dist(spark, sf_dir):
    return reports.comp_dist(nation_supplier(spark, sf_dir), aggregated=True)


@query("SELECT false AS nations, true AS orders, false AS orders_s9")
def is_connected(spark, sf_dir):
    orders = order_part(spark, sf_dir)
    row = (nation_supplier(spark, sf_dir).is_connected(), orders.is_connected(), orders.is_connected(9))
    return spark.createDataFrame([row], "nations boolean, orders boolean, orders_s9 boolean")


@query(_REACH2 + " SELECT id, component FROM comp")
def components_s2(spark, sf_dir):
    return connectivity.component_labels(order_part(spark, sf_dir), 2)


@query(_REACH2 + ", c AS (SELECT count(*) AS size FROM comp GROUP BY component) SELECT size, count(*) AS n FROM c GROUP BY size")
def component_hist_s2(spark, sf_dir):
    return reports.s_comp_dist(order_part(spark, sf_dir), 2, aggregated=True)


@query(_REACH2 + ", c AS (SELECT component, count(*) AS n FROM comp GROUP BY component HAVING n > 1) SELECT edge, node, component FROM inc JOIN comp ON id = edge JOIN c USING (component)")
def component_subgraphs_s2(spark, sf_dir):
    return connectivity.labelled_incidences(order_part(spark, sf_dir), 2).select("edge", "node", "component")


# Walks of up to 40 steps, more than any shortest one has; an edge without s-neighbours has no distance.
_DIST2 = _REACH2 + """, v AS (SELECT id FROM comp),
b(src, dst, d) AS (SELECT id, id, 0 FROM v UNION SELECT b.src, l.dst, d + 1 FROM b JOIN l ON l.src = b.dst WHERE d < 40),
dist AS (SELECT src, dst, min(d) AS d FROM b GROUP BY ALL HAVING src <> dst)"""


@query(_DIST2 + " SELECT src, dst, d::BIGINT AS distance FROM dist")
def distances_s2(spark, sf_dir):
    return connectivity.s_distances(order_part(spark, sf_dir), 2)[1]


@query(_DIST2 + " SELECT id, round(coalesce(count(d) / sum(d), 0), 6) AS value FROM v LEFT JOIN dist ON src = id GROUP BY id")
def closeness_s2(spark, sf_dir):
    return centrality.s_closeness_centrality(order_part(spark, sf_dir), 2).withColumn("value", F.round("value", 6))


@query(_DIST2 + " SELECT id, round(coalesce(sum(1 / d), 0), 6) AS value FROM v LEFT JOIN dist ON src = id GROUP BY id")
def harmonic_s2(spark, sf_dir):
    return centrality.s_harmonic_centrality(order_part(spark, sf_dir), 2).withColumn("value", F.round("value", 6))


@query(_DIST2 + " SELECT component, coalesce(max(d), 0)::BIGINT AS diameter FROM comp LEFT JOIN dist ON id = src GROUP BY component")
def diameters_s2(spark, sf_dir):
    return connectivity.component_diameters(order_part(spark, sf_dir), 2, edges=True).select("component", "diameter")


_PATHS2 = _DIST2 + """, p(src, dst, d, n) AS (SELECT id, id, 0, 1.0::DOUBLE FROM v UNION ALL
SELECT src, dst, d, sum(n) FROM (SELECT p.src, l.dst, p.d + 1 AS d, p.n FROM p JOIN l ON l.src = p.dst JOIN dist x ON x.src = p.src AND x.dst = l.dst AND x.d = p.d + 1) GROUP BY ALL),
through AS (SELECT a.dst AS id, sum(a.n * b.n / c.n) / 2 AS raw FROM p a JOIN p b ON b.src = a.dst JOIN p c ON c.src = a.src AND c.dst = b.dst AND c.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.dst)"""


@query(_PATHS2 + " SELECT v.id, round(coalesce(raw, 0) * 2 / ((SELECT count(*) - 1.0 FROM v) * (SELECT count(*) - 2 FROM v)), 12) AS value FROM v LEFT JOIN through USING (id)")
def betweenness_s2(spark, sf_dir):
    return centrality.s_betweenness_centrality(order_part(spark, sf_dir), 2).withColumn("value", F.round("value", 12))


def _ends(graph: HGraph, column: str) -> tuple:
    row = graph.pairs.agg(F.min(column), F.max(column)).first()
    return row[0], row[1]


_NODE_WALK = _NODE_PAIRS + """, nl AS (SELECT src, dst FROM np UNION ALL SELECT dst, src FROM np), ends AS (SELECT min(node) AS a, max(node) AS z FROM inc),
w(id, d) AS (SELECT a, 0 FROM ends UNION SELECT nl.dst, d + 1 FROM w JOIN nl ON nl.src = w.id WHERE d < 6)"""


@query(_NODE_WALK + " SELECT min(d)::BIGINT AS distance FROM w JOIN ends ON id = z")
def node_distance(spark, sf_dir):
    """Between the least and the greatest node."""
    graph = order_part(spark, sf_dir)
    return spark.createDataFrame([(graph.distance(*_ends(graph, "node")),)], "distance long")


_EDGE_WALK = _EDGE_PAIRS + """, el AS (SELECT src, dst FROM ep UNION ALL SELECT dst, src FROM ep), ends AS (SELECT min(edge) AS a, max(edge) AS z FROM inc),
w(id, d) AS (SELECT a, 0 FROM ends UNION SELECT el.dst, d + 1 FROM w JOIN el ON el.src = w.id WHERE d < 6)"""


@query(_EDGE_WALK + " SELECT min(d)::BIGINT AS distance FROM w JOIN ends ON id = z")
def edge_distance(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    return spark.createDataFrame([(graph.edge_distance(*_ends(graph, "edge")),)], "distance long")


_SUPPLIERS = """, sp AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM ps a JOIN ps b ON a.edge = b.edge AND a.node <> b.node), sv AS (SELECT DISTINCT node AS id FROM ps),
sb(src, dst, d) AS (SELECT id, id, 0 FROM sv UNION SELECT sb.src, sp.dst, d + 1 FROM sb JOIN sp ON sp.src = sb.dst WHERE d < 6), sd AS (SELECT src, dst, min(d) AS d FROM sb GROUP BY ALL)"""


@query(_SUPPLIERS + " SELECT src AS id, max(d)::BIGINT AS value FROM sd GROUP BY src")
def eccentricity(spark, sf_dir):
    """Of suppliers that share parts."""
    return centrality.s_eccentricity(part_supplier(spark, sf_dir), 1, edges=False).withColumn("value", F.col("value").cast("long"))


@query(_SUPPLIERS + " SELECT max(d)::BIGINT AS diameter FROM sd")
def diameter(spark, sf_dir):
    return spark.createDataFrame([(part_supplier(spark, sf_dir).diameter(),)], "diameter long")


@query(_SUPPLIERS + " SELECT max(d)::BIGINT AS diameter FROM sd")
def edge_diameter(spark, sf_dir):
    """Of suppliers as edges, whose nodes are parts."""
    return spark.createDataFrame([(part_supplier(spark, sf_dir).dual().edge_diameter(),)], "diameter long")


# -- reading single ids, edits, constructors ----------------------------------------------------------------------


@query(", t AS (SELECT edge, node // 10 AS node, node AS was, weight FROM inc) SELECT edge, node, min_by(weight, was) AS weight FROM t GROUP BY ALL")
def rename_nodes(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    mapping = graph.pairs.select(F.col("node").alias("old"), F.expr("node div 10").alias("new")).distinct()
    return graph.rename(nodes=mapping).incidences.select("edge", "node", "weight")


_LEAST = ", le AS (SELECT min(edge) AS edge FROM inc), ln1 AS (SELECT min(node) AS node FROM inc)"


@query(
    _LEAST
    + """ SELECT (SELECT count(*) FROM degrees) AS n_nodes, (SELECT count(*) FROM sizes) AS n_edges, true AS same, false AS same_without, true AS held, false AS held_other,
    (SELECT size FROM sizes JOIN le USING (edge)) AS size, (SELECT size - 1 FROM sizes JOIN le USING (edge)) AS dim, (SELECT count(*) FROM inc JOIN le USING (edge) WHERE node % 2 = 0) AS size_even,
    (SELECT degree FROM degrees JOIN ln1 USING (node)) AS degree, (SELECT count(*) FROM inc JOIN ln1 USING (node) JOIN sizes USING (edge) WHERE size BETWEEN 2 AND 3) AS degree_2_3"""
)
def graph_facts(spark, sf_dir):
    """Shape, equality with a copy and with a lesser graph, membership, and the least edge's and node's numbers."""
    graph = order_part(spark, sf_dir).persist()
    edge, node = graph.pairs.agg(F.min("edge"), F.min("node")).first()
    even = graph.pairs.filter("node % 2 = 0").select("node").distinct()
    lesser = graph.remove_edges([edge])
    row = (*graph.shape, graph.clone("copy") == graph, lesser == graph, node in graph, -1 in graph, graph.size(edge), graph.dim(edge), graph.size(edge, even), graph.degree(node), graph.degree(node, 2, 3))
    graph.incidences.unpersist()
    kinds = "n_nodes long, n_edges long, same boolean, same_without boolean, held boolean, held_other boolean, size long, dim long, size_even long, degree long, degree_2_3 long"
    return spark.createDataFrame([row], kinds)


@query(
    _LEAST
    + """ SELECT (SELECT count(*) FROM sizes) AS n_edges, (SELECT count(*) FROM degrees) AS n_nodes, (SELECT count(*) FROM inc) AS n_cells, false AS empty, true AS held, false AS held_other,
    (SELECT edge FROM le) AS first_edge, (SELECT count(*) FROM inc JOIN le USING (edge)) AS n_members, (SELECT o_totalprice::DOUBLE FROM orders JOIN le ON edge = o_orderkey) AS weight,
    (SELECT o_orderstatus FROM orders JOIN le ON edge = o_orderkey) AS status, 1.0::DOUBLE AS node_weight, (SELECT weight FROM inc JOIN le USING (edge) ORDER BY node LIMIT 1) AS cell_weight"""
)
def view_facts(spark, sf_dir):
    """Views: lengths, membership, the first id, and the properties of single ids at all three levels."""
    stored = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_totalprice").cast("double").alias("weight"), F.col("o_orderstatus").alias("status"))
    graph = order_part(spark, sf_dir).persist().with_properties(edge_properties=stored)
    edge = next(iter(graph.edges))
    members = graph.edges[edge]
    row = (
        *(len(view) for view in (graph.edges, graph.nodes, graph.cells)), graph.edges.is_empty(), (edge, members[0]) in graph.cells, (edge, -1) in graph.cells, edge, len(members),
        members.weight, graph.get_properties(edge, 0, "status"), graph.get_properties(members[0], 1)["weight"], graph.get_cell_properties(edge, members[0], "weight"),
    )
    graph.incidences.unpersist()
    kinds = "n_edges long, n_nodes long, n_cells long, empty boolean, held boolean, held_other boolean, first_edge long, n_members long, weight double, status string, node_weight double, cell_weight double"
    return spark.createDataFrame([row], kinds)


@query(
    """SELECT o_orderkey AS uid, CASE WHEN o_orderkey = 1 THEN 5.0 ELSE o_totalprice END::DOUBLE AS weight, CASE o_orderkey WHEN 1 THEN 'seen' WHEN 2 THEN 'held' ELSE o_orderstatus END AS status,
    CASE o_orderkey WHEN 2 THEN 'red' ELSE 'grey' END AS colour FROM orders UNION ALL SELECT -1, 7.0, NULL, 'grey'"""
)
def property_edits(spark, sf_dir):
    """Single and several values set, an id without a row before, and a default that becomes a column."""
    stored = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_totalprice").cast("double").alias("weight"), F.col("o_orderstatus").alias("status"))
    graph = order_part(spark, sf_dir).with_properties(edge_properties=stored)
    edited = graph.edge_properties.set_properties(1, {"weight": 5.0, "status": "seen"}).set_property(2, "status", "held").set_property(2, "colour", "red").set_property(-1, "weight", 7.0)
    return edited.set_defaults({"colour": "grey"}).table.select("uid", "weight", "status", "colour")


@query("SELECT edge, node, 2.0::DOUBLE AS weight, coalesce(o_orderpriority, 'none') AS priority FROM inc LEFT JOIN orders ON o_orderkey = edge")
def view_defaults(spark, sf_dir):
    """Defaults of a view: a column of the edges' view, filled where an edge has none; cells keep their edge's."""
    stored = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.lit(2.0).alias("weight"), F.col("o_orderpriority").alias("priority"))
    graph = order_part(spark, sf_dir).with_properties(edge_properties=stored).edges.set_defaults({"priority": "none"})
    return graph.pairs.join(graph.edges.dataframe().withColumnRenamed("uid", "edge"), "edge").select("edge", "node", "weight", "priority")


@query("SELECT edge, node FROM inc")
def array_column_round_trip(spark, sf_dir):
    """To a row for each edge with the array of its nodes, and back."""
    return build.from_array_column(order_part(spark, sf_dir).elements(), "nodes", "edge").pairs


@query("SELECT dense_rank() OVER (ORDER BY edge) - 1 AS edge, node FROM nat")
def sets_constructor(spark, sf_dir):
    """A list of sets, nations in order; an edge's id is its place."""
    sets = [r["nodes"] for r in nation_supplier(spark, sf_dir).elements().orderBy("edge").collect()]
    return build.hypergraph(spark, sets).pairs


@query("SELECT edge::BIGINT AS edge, node FROM nat")
def pairs_constructor(spark, sf_dir):
    """An array of two columns."""
    return build.hypergraph(spark, nation_supplier(spark, sf_dir).pairs.toPandas().to_numpy()).pairs


class _Coordinates:
    """A sparse matrix as the constructors take it."""

    def __init__(self, cells, shape):
        self.row, self.col, self.data, self.shape = cells["i"].to_numpy(), cells["j"].to_numpy(), cells["value"].to_numpy(), shape


@query(
    """, n AS (SELECT node, dense_rank() OVER (ORDER BY node) - 1 AS i FROM ue), e AS (SELECT edge, dense_rank() OVER (ORDER BY edge) - 1 AS j FROM ue)
    SELECT 'e' || j AS edge, 'v' || i AS node, weight FROM ue JOIN (SELECT DISTINCT * FROM n) USING (node) JOIN (SELECT DISTINCT * FROM e) USING (edge)"""
)
def sparse_matrix(spark, sf_dir):
    """A sparse matrix by coordinates, sent as arrays."""
    graph = user_event(spark, sf_dir)
    cells, nodes, edges = pairs.incidence_matrix(graph, weights=True)
    matrix = _Coordinates(cells.toPandas(), (nodes.count(), edges.count()))
    return build.from_numpy_array(spark, matrix).incidences.select("edge", "node", "weight")


# -- matching, homology numbers, random ---------------------------------------------------------------------------


def _uniform(spark, sf_dir) -> HGraph:
    graph = order_part(spark, sf_dir)
    return graph.restrict_to_edges(graph.edge_sizes().filter("size = 3"))


@query(
    """, u AS (SELECT inc.edge, node FROM inc JOIN sizes USING (edge) WHERE size = 3), e AS (SELECT edge, list(node) AS ns, row_number() OVER (ORDER BY edge) AS r FROM u GROUP BY edge),
    g(r, used, taken) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL
    SELECT e.r, CASE WHEN list_has_any(g.used, e.ns) THEN g.used ELSE list_concat(g.used, e.ns) END, CASE WHEN list_has_any(g.used, e.ns) THEN NULL ELSE e.edge END FROM g JOIN e ON e.r = g.r + 1)
    SELECT taken AS edge FROM g WHERE taken IS NOT NULL"""
)
def maximal_matching(spark, sf_dir):
    return matching.maximal_matching(_uniform(spark, sf_dir))


@query()
def greedy_matching(spark, sf_dir):
    return matching.greedy_matching(_uniform(spark, sf_dir), 4)


@query()
def iterated_sampling(spark, sf_dir):
    return matching.iterated_sampling(_uniform(spark, sf_dir), 1000)


@query()
def hedcs_matching(spark, sf_dir):
    return matching.HEDCS_matching(_uniform(spark, sf_dir), 1000, beta=9, beta_minus=5)


@query()
def betti(spark, sf_dir):
    found = homology.betti_numbers(user_event(spark, sf_dir))
    return spark.createDataFrame(sorted(found.items()), "k int, betti long")


@query()
def spec_clus(spark, sf_dir):
    return walks.spec_clus(part_supplier(spark, sf_dir), 3)


@query()
def kumar(spark, sf_dir):
    return communities.kumar(part_supplier(spark, sf_dir))


@query()
def last_step(spark, sf_dir):
    graph = user_event(spark, sf_dir).dual()
    parts = graph.pairs.select("node", (F.col("node") % 4).cast("int").alias("part")).distinct()
    return communities.last_step(graph, parts)


def _rates() -> dict[int, float]:
    return dict.fromkeys(range(1, 30), 0.2)


@query()
def discrete_sir(spark, sf_dir):
    return epidemics.discrete_SIR(order_part(spark, sf_dir), _rates(), 0.5, rho=0.05, tmax=5, seed=1)


@query()
def discrete_sis(spark, sf_dir):
    return epidemics.discrete_SIS(order_part(spark, sf_dir), _rates(), 0.5, rho=0.05, tmax=5, seed=1)


@query()
def gillespie_sir(spark, sf_dir):
    return epidemics.Gillespie_SIR(order_part(spark, sf_dir), _rates(), 0.5, rho=0.05, tmax=0.5, dt=0.1, seed=1)


@query()
def gillespie_sis(spark, sf_dir):
    return epidemics.Gillespie_SIS(order_part(spark, sf_dir), _rates(), 0.5, rho=0.05, tmax=0.5, dt=0.1, seed=1)


@query()
def erdos_renyi(spark, sf_dir):
    nodes, edges = order_part(spark, sf_dir).shape
    return generators.erdos_renyi_hypergraph(spark, nodes, edges, 0.002, seed=1).pairs


@query()
def chung_lu(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    return generators.chung_lu_hypergraph(spark, graph.node_degrees(), graph.edge_sizes(), seed=1).pairs


@query()
def dcsbm(spark, sf_dir):
    graph = order_part(spark, sf_dir)
    nodes, edges = (graph.pairs.select(c).distinct().withColumn("g", (F.col(c) % 2).cast("int")) for c in ("node", "edge"))
    half = graph.incidences.count() / 2
    return generators.dcsbm_hypergraph(spark, graph.node_degrees(), graph.edge_sizes(), nodes, edges, [[half, 0], [0, half]], seed=1).pairs


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of edge sizes."""
    return size_hist(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "class_map", "flagship", "transforms"]
