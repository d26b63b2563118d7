"""Pairs of edges that share nodes, of nodes that share edges, and what follows from them.

The kernel is a self-join on the opposite id that emits each pair once (src < dst) with the number of shared ids. Its
output grows with the square of hub sizes, so ids that can't reach s are dropped before. From s = PREFIX_FROM on a
prefix filter drops most candidates: with the opposite ids of each set in ascending order of frequency, two sets that
share s of them share one of the first size - s + 1 of each. Where it drops little, as for smaller s, counting is cheaper.
For s = 2 two sets may also meet at the pairs of ids that both hold, where sets are small and those pairs fewer. The
tasks of these joins grow in number with the pairs that they make, and an id that makes many is dealt over several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TooLargeError
from ..graph import EDGES, NODES, HGraph, id_table, side
from ..plans.guards import bounded_rows
from ..plans.lineage import cut_lineage, written as write

#: The most columns of a wide table.
MOST_COLUMNS = 5_000
#: The longest list of one id's neighbours.
MOST_NEIGHBORS = 1_000_000
#: The least s for which candidates come from prefixes.
PREFIX_FROM = 4
#: Pairs that a task makes or counts.
TASK_PAIRS = 1_000_000


def pair_estimate(graph: HGraph, level: int) -> int:
    """How many pairs, repetitions included, the self-join makes."""
    _, other = side(level)
    degrees = graph.incidences.groupBy(other).agg(F.count("*").alias("d"))
    return degrees.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0))).first()[0]


def pair_counts(graph: HGraph, level: int = EDGES, s: int = 1, most_pairs: int | None = None, written: bool = False) -> DataFrame:
    """src, dst, overlap for pairs src < dst of edges (level 0) or nodes (1) that share at least s ids. written: the graph's
    incidences are cut from their lineage, and cheap to read again."""
    own, other = side(level)
    if most_pairs is not None and (n := pair_estimate(graph, level)) > most_pairs:
        raise TooLargeError(f"about {n:.0f} pairs; raise s, restrict the graph, or allow more")
    pairs = graph.pairs.select(own, other)
    pairs = pairs if written else write(pairs)
    if s >= PREFIX_FROM and (found := _by_prefixes(pairs, own, other, s)) is not None:
        return found
    by_own = pairs.repartition(_tasks(pairs, pairs.count()), own)
    kept = _of_size(by_own, own, s) if s <= 2 else write(_of_size(by_own, own, s))
    made, most = _pairs_made(kept, other)
    if s == 2 and (by_two := _pairs_made(by_own, own))[0] < made:  # a set of one makes no pairs
        return _sharing_two(pairs, own, other, *by_two)
    met = _within(kept, other, own, made, most).repartition(_tasks(pairs, made), "src", "dst")
    counts = met.groupBy("src", "dst").agg(F.count("*").alias("overlap"))
    return counts.filter(F.col("overlap") >= s) if s > 1 else counts


def _by_prefixes(pairs: DataFrame, own: str, other: str, s: int) -> DataFrame | None:
    """pair_counts by the candidates of prefixes; None if they with the sets that verify them are no fewer values than the pairs."""
    pairs = _of_size(pairs, own, s)
    degrees = pairs.groupBy(other).agg(F.count("*").alias("degree")).filter("degree > 1")
    n, ids, made = degrees.agg(F.sum("degree"), F.count("*"), F.sum(F.expr("degree * (degree - 1) div 2"))).first()
    # Prefixes of so many rows in all make the fewest candidates where all ids are in as many of them.
    left = (n or 0) - (s - 1) * pairs.select(own).distinct().count()
    if left > ids and s * left * (left / ids - 1) >= made:
        return None
    ranked = pairs.join(degrees, other)
    # Opposite ids of degree 1 are in no pair; a set is then as large as what is left of it.
    sets = ranked.groupBy(own).agg(F.array_sort(F.collect_list(F.struct("degree", F.col(other).alias("id")))).alias("ids")).filter(F.size("ids") >= s)
    sets = sets.select(F.col(own).alias("own"), F.transform("ids", lambda x: x["id"]).alias("ids"))
    prefix = sets.select("own", F.explode(F.slice("ids", F.lit(1), F.size("ids") - (s - 1))).alias("id"), F.size("ids").alias("n"))
    likely = prefix.groupBy("id").agg(F.count("*").alias("d"), F.sum("n").alias("n")).agg(F.sum((F.col("d") - 1) * F.col("n"))).first()[0] or 0
    if likely >= (made or 0):
        return None
    candidates = prefix.select(F.col("own").alias("src"), "id").join(prefix.select(F.col("own").alias("dst"), "id"), "id").filter("src < dst").select("src", "dst").distinct()
    both = candidates.join(sets.toDF("src", "ids_a"), "src").join(sets.toDF("dst", "ids_b"), "dst")
    return both.select("src", "dst", F.size(F.array_intersect("ids_a", "ids_b")).cast("long").alias("overlap")).filter(F.col("overlap") >= s)


def _of_size(pairs: DataFrame, own: str, s: int) -> DataFrame:
    """The pairs of ids with at least s of them."""
    return pairs if s <= 1 else pairs.join(pairs.groupBy(own).agg(F.count("*").alias("size")).filter(F.col("size") >= s), own, "left_semi")


def _pairs_made(pairs: DataFrame, key: str) -> tuple[int, int]:
    """How many pairs the ids of a key make, of all keys and of the one with the most."""
    degrees = pairs.groupBy(key).agg(F.count("*").alias("d")).select(F.expr("d * (d - 1) div 2").alias("n"))
    made, most = degrees.agg(F.sum("n"), F.max("n")).first()
    return made or 0, most or 0


def _tasks(pairs: DataFrame, made: int) -> int:
    return max(pairs.sparkSession.sparkContext.defaultParallelism, -(-made // TASK_PAIRS))


def _within(pairs: DataFrame, key: str, of: str, made: int, most: int) -> DataFrame:
    """key, src, dst: the pairs src < dst of ids `of` with the same key. A key of more than TASK_PAIRS is dealt over tasks by src."""
    a, b, on = pairs.select(key, F.col(of).alias("src")), pairs.select(key, F.col(of).alias("dst")), [key]
    if most > TASK_PAIRS:
        degrees = pairs.groupBy(key).agg(F.count("*").alias("_d"))
        hubs = degrees.select(key, F.expr(f"(_d * (_d - 1) div 2) div {TASK_PAIRS} + 1").alias("_parts")).filter("_parts > 1")
        parts = F.coalesce("_parts", F.lit(1))
        a = a.join(hubs, key, "left").withColumn("_part", F.pmod(F.xxhash64("src"), parts)).drop("_parts")
        b = b.join(hubs, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
        on = [key, "_part"]
    n = _tasks(pairs, made)
    return a.repartition(n, *on).join(b.repartition(n, *on), on).filter("src < dst").select(key, "src", "dst")


def _sharing_two(pairs: DataFrame, own: str, other: str, made: int, most: int) -> DataFrame:
    """src, dst, overlap of ids that share two others at least: they meet at each pair of those, n (n - 1) / 2 times for an overlap of n."""
    twos = _within(pairs, own, other, made, most).toDF("own", "x", "y").repartition(_tasks(pairs, made), "x", "y")
    again = twos.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").select("x", "y")
    twos = cut_lineage(twos.join(again, ["x", "y"], "left_semi"))
    met = twos.withColumnRenamed("own", "src").join(twos.withColumnRenamed("own", "dst"), ["x", "y"]).filter("src < dst")
    counts = met.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counts.select("src", "dst", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("overlap"))


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Every pair both ways, from one reading."""
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.select(F.explode(ways).alias("_way"), *rest).select("_way.src", "_way.dst", *rest)


def get_linegraph(graph: HGraph, s: int = 1, edges: bool = True) -> tuple[DataFrame, DataFrame]:
    """vertices (id) and links (src < dst, overlap): edges (or nodes) that share at least s ids; isolated ones stay. Both come
    from one reading of the incidences."""
    level = EDGES if edges else NODES
    graph = HGraph.of(write(graph.pairs))
    return graph.pairs.select(F.col(side(level)[0]).alias("id")).distinct(), pair_counts(graph, level, s, None, True)


def adjacency_matrix(graph: HGraph, s: int = 1) -> DataFrame:
    """row, col, value 1 for nodes that share at least s edges, both triangles."""
    return _mirrored(pair_counts(graph, NODES, s)).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1).alias("value"))


def edge_adjacency_matrix(graph: HGraph, s: int = 1) -> DataFrame:
    """row, col, value 1 for edges that share at least s nodes, both triangles."""
    return _mirrored(pair_counts(graph, EDGES, s)).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1).alias("value"))


def auxiliary_matrix(graph: HGraph, s: int = 1, node: bool = True) -> tuple[DataFrame, DataFrame]:
    """ids with at least one neighbour, and the adjacency among them."""
    matrix = adjacency_matrix(graph, s) if node else edge_adjacency_matrix(graph, s)
    return matrix.select(F.col("row").alias("id")).distinct(), matrix


def neighbor_table(graph: HGraph, uid, s: int = 1, level: int = NODES) -> DataFrame:
    """node (or edge, at level 0) and overlap: what shares at least s ids with one node (or edge)."""
    own, other = side(level)
    mine = graph.pairs.filter(F.col(own) == F.lit(uid)).select(other)
    near = graph.pairs.join(mine, other, "left_semi").filter(F.col(own) != F.lit(uid))
    return near.groupBy(own).agg(F.count("*").alias("overlap")).filter(F.col("overlap") >= s)


def neighbors(graph: HGraph, node, s: int = 1) -> list:
    """Nodes that share at least s edges with a node, sorted; none for an unknown one. More than MOST_NEIGHBORS raise;
    neighbor_table has them all."""
    return sorted(r[0] for r in bounded_rows(neighbor_table(graph, node, s), MOST_NEIGHBORS, "neighbours"))


def edge_neighbors(graph: HGraph, edge, s: int = 1) -> list:
    """Edges that share at least s nodes with an edge, sorted; none for an unknown one. Bounded as neighbors are."""
    return sorted(r[0] for r in bounded_rows(neighbor_table(graph, edge, s, EDGES), MOST_NEIGHBORS, "neighbours"))


def containment(graph: HGraph, collapse: bool = True) -> DataFrame:
    """src, dst: edges and the edges that they are within. Equal edges are linked, the lesser id to the greater, only
    where collapse is false; else of each class of equal edges the least stands for all.

    An edge's supersets all hold its rarest node, so it meets the edges of that node only. A set of 64 bits for each
    edge drops most of those; what is left is compared node by node.
    """
    if collapse:
        from .transforms import class_map, restrict_to_edges

        graph = restrict_to_edges(graph, class_map(graph, EDGES).select(F.col("rep").alias("edge")).distinct())
    degrees = graph.pairs.groupBy("node").agg(F.count("*").alias("degree"))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(node), 64) as int))")
    rarest = F.min(F.struct("degree", "node"))["node"]
    sets = graph.pairs.join(degrees, "node").groupBy("edge").agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"), rarest.alias("node"))
    small = sets.select("node", F.col("edge").alias("src"), F.col("n").alias("n_src"), F.col("bits").alias("bits_src"))
    large = graph.pairs.join(sets.drop("node"), "edge").select("node", F.col("edge").alias("dst"), F.col("n").alias("n_dst"), F.col("bits").alias("bits_dst"))
    fits = (F.col("n_src") < F.col("n_dst")) | ((F.col("n_src") == F.col("n_dst")) & (F.col("src") < F.col("dst")))
    likely = small.join(large, "node").filter(fits & (F.col("bits_src").bitwiseAND(F.bitwise_not("bits_dst")) == 0))
    sure = likely.filter("n_src = 1").select("src", "dst")
    elements = graph.elements()
    open_pairs = likely.filter("n_src > 1").select("src", "dst").join(elements.toDF("src", "nodes_src"), "src").join(elements.toDF("dst", "nodes_dst"), "dst")
    return sure.unionByName(open_pairs.filter(F.size(F.array_except("nodes_src", "nodes_dst")) == 0).select("src", "dst"))


def toplexes(graph: HGraph) -> DataFrame:
    """Edges that are within no other edge; of equal edges the least."""
    from .transforms import class_map, restrict_to_edges

    least = class_map(graph, EDGES).select(F.col("rep").alias("edge")).distinct()
    inside = containment(restrict_to_edges(graph, least), collapse=False).select(F.col("src").alias("edge")).distinct()
    return least.join(inside, "edge", "left_anti")


def toplex_graph(graph: HGraph, name: str | None = None) -> HGraph:
    """The graph restricted to its toplexes."""
    from .transforms import restrict_to_edges

    return restrict_to_edges(graph, toplexes(graph), name)


# -- matrices and other forms -------------------------------------------------------------------------------------


def dense_index(ids: DataFrame, *columns: str) -> DataFrame:
    """columns, idx: places in the sorted order of distinct ids. Ids are sorted by range, written, and counted by partition;
    a partition's ids are numbered on from those before it, whose counts are one row each."""
    ids = ids.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    # The id's upper bits are the partition, the lower 33 the place in it.
    placed = cut_lineage(ids.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2**33 - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    return placed.withColumn("_part", part).join(offsets, "_part").select(*columns, (place + F.col("_before")).alias("idx"))


def incidence_matrix(graph: HGraph, weights: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """i (node), j (edge), value in long form, and the indices of nodes and edges."""
    nodes, edges = dense_index(graph.incidences, "node"), dense_index(graph.incidences, "edge")
    value = F.col("weight") if weights else F.lit(1.0)
    cells = graph.incidences.join(nodes.withColumnRenamed("idx", "i"), "node").join(edges.withColumnRenamed("idx", "j"), "edge")
    return cells.select("i", "j", value.alias("value")), nodes, edges


def incidence_dataframe(graph: HGraph, weights: bool = False, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """A wide table: a row a node, a column an edge, 0 where there is no incidence."""
    rows = graph.incidences.select("edge").distinct().limit(most_columns + 1).collect()
    if len(rows) > most_columns:
        raise TooLargeError(f"more than {most_columns} edges, one column each")
    value = F.col("weight") if weights else F.lit(1.0)
    return graph.incidences.groupBy("node").pivot("edge", sorted(r[0] for r in rows)).agg(F.first(value)).na.fill(0)


def bipartite(graph: HGraph, keep_data: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices (id as text, side 0 for edges and 1 for nodes) and links (edge, node)."""
    if keep_data:
        e, n = graph.edges.dataframe(), graph.nodes.dataframe()
        e, n = (d.withColumn("id", F.col("uid").cast("string")).drop("uid") for d in (e, n))
    else:
        e, n = (graph.incidences.select(F.col(c).cast("string").alias("id")).distinct() for c in ("edge", "node"))
    vertices = e.withColumn("side", F.lit(0)).unionByName(n.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return vertices, graph.incidences if keep_data else graph.pairs


def overlap_with(graph: HGraph, nodes, level: int = EDGES) -> DataFrame:
    """How many of the given ids each edge (or node) holds, where it holds some."""
    own, other = side(level)
    given = id_table(graph.spark, nodes, graph.incidences.schema[other].dataType, other)
    return graph.pairs.join(given, other, "left_semi").groupBy(own).agg(F.count("*").alias("overlap"))


def share(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))
