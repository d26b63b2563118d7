"""Partitions of nodes: modularity, conductance, two-section, and searches for communities."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SetGraphError
from ..functions.rules import linear
from ..graph import HGraph, id_table
from ..plans.guards import bounded_rows
from ..plans.lineage import cut_lineage, written
from .connectivity import component_labels
from .pairs import dense_index

#: The most pairs of a size of edges and a number of nodes whose expected weights go to every task.
MOST_TERMS = 100_000
#: The most different volumes of parts that go to every task.
MOST_VOLUMES = 100_000
#: Numbers that a task holds at a time when volumes meet sizes of edges.
GRID = 2_000_000
#: Smaller gains of a move may be errors of rounding.
LEAST_GAIN = 0.1
#: The same for a node's move, as a part of all weight.
LEAST_RISE = 1e-10
#: Links of a block of nodes that move one after another.
BLOCK_LINKS = 500_000
#: Incidences, pairs of nodes within edges, and different ones of these (the links) up to which components are searched in one task.
WHOLE_CELLS, WHOLE_PAIRS, WHOLE_LINKS = 1_000_000, 20_000_000, 2_000_000
#: Pairs that a task adds up at a time, and squares of numbers of nodes for which it holds all pairs.
PAIRS_AT_ONCE, DENSE_PAIRS = 2_000_000, 4_000_000
#: Incidences of a task that only joins or groups them.
TASK_CELLS = 200_000


def part2dict(parts: Iterable[Iterable]) -> dict:
    """From a list of sets the part of each node."""
    return {node: i for i, part in enumerate(parts) for node in part}


def dict2part(parts: Mapping) -> list[set]:
    """From the part of each node a list of sets."""
    found: dict = {}
    for node, part in parts.items():
        found.setdefault(part, set()).add(node)
    return list(found.values())


def part_table(graph: HGraph, parts: DataFrame | Mapping | Iterable[Iterable]) -> DataFrame:
    """node, part from a table, a mapping or a list of sets."""
    if isinstance(parts, DataFrame):
        return parts.select("node", "part")
    given = parts if isinstance(parts, Mapping) else part2dict(parts)
    kind = graph.incidences.schema["node"].dataType.simpleString()
    return graph.spark.createDataFrame(list(given.items()), f"node {kind}, part int")


def edge_weights(graph: HGraph) -> DataFrame:
    """edge, w: stored weights, the default for the others."""
    w = graph.edges.dataframe().select(F.col("uid").alias("edge"), F.col("weight").alias("w"))
    return w


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series for n + 8, less the logarithms of the eight factors too many; right to 11 digits."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - F.log(reduce(operator.mul, (n + i for i in range(1, 9)), F.lit(1.0)))


def binomial(c: Column, d: Column, p: Column) -> Column:
    """The probability of c of d at p."""
    choices = log_factorial(d) - log_factorial(c) - log_factorial(d - c)
    inner = F.exp(choices + c * F.log(p) + (d - c) * F.log(1 - p))
    return F.when(p >= 1, (c == d).cast("double")).when(p <= 0, (c == 0).cast("double")).otherwise(inner)


def modularity(graph: HGraph, parts: DataFrame | Mapping | Iterable[Iterable], wdc: Callable[[Column, Column], Column] = linear, weighted: bool | None = None) -> float:
    """The part of edge weight within majorities of a part, less what is expected from degrees.

    Sizes of edges and volumes of parts meet, each of them grouped first. Of the two the volumes go to every task if
    there are at most MOST_VOLUMES, else the sizes; more than MOST_TERMS of these raise then. weighted None: by edge
    weights where some are stored.
    """
    if weighted is None:
        weighted = not graph.edge_properties.table.isEmpty()
    weights = edge_weights(graph) if weighted else graph.incidences.select("edge").distinct().withColumn("w", F.lit(1.0))
    placed = graph.pairs.join(part_table(graph, parts), "node").join(weights, "edge")
    counts = placed.groupBy("edge", "w", "part").agg(F.count("*").alias("c"))
    edges = counts.groupBy("edge", "w").agg(F.sum("c").alias("d"), F.max("c").alias("c")).persist()
    d, c = F.col("d"), F.col("c")
    inside, total = edges.agg(F.sum(F.when(c > d / 2, F.col("w") * wdc(d, c)).otherwise(0.0)), F.sum("w")).first()
    if not total:
        raise SetGraphError("modularity of a graph without edges")
    volumes = placed.groupBy("part").agg(F.sum("w").alias("vol"))
    whole = volumes.agg(F.sum("vol")).first()[0]
    volumes = cut_lineage(volumes.groupBy("vol").agg(F.count("*").alias("same")).withColumn("p", F.col("vol") / whole))
    sizes = edges.groupBy("d").agg(F.sum("w").alias("n_d")).withColumn("c", F.explode(F.sequence(F.floor(d / 2) + 1, d)))
    sizes = sizes.withColumn("v", F.col("n_d") * wdc(d, F.col("c"))).filter("v <> 0")
    if volumes.count() <= MOST_VOLUMES:
        met = sizes.join(F.broadcast(volumes), F.lit(True)).select((F.col("v") * F.col("same") * binomial(F.col("c"), d, F.col("p"))).alias("x"))
    else:
        terms = bounded_rows(sizes.select("d", "c", "v"), MOST_TERMS, f"sizes of edges, of a graph with more than {MOST_VOLUMES} volumes of parts")
        met = volumes.select("same", _expected(terms, whole)("vol").alias("x")).select((F.col("same") * F.col("x")).alias("x"))
    tax = met.agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
    edges.unpersist()
    return (inside - tax) / total


def conductance_row(graph: HGraph, nodes: DataFrame | Iterable) -> DataFrame:
    """One row: cut (sizes of edges that cross the set), volume (degrees within it), outside (nodes beyond it)."""
    chosen = id_table(graph.spark, nodes, graph.incidences.schema["node"].dataType, "node").withColumn("_in", F.lit(1))
    marked = graph.pairs.join(chosen, "node", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    edges = marked.groupBy("edge").agg(F.count("*").alias("size"), F.sum("_in").alias("inside"))
    cut = F.sum(F.when((F.col("inside") > 0) & (F.col("inside") < F.col("size")), F.col("size")).otherwise(0))
    return edges.agg(cut.alias("cut"), F.sum("inside").alias("volume"), F.sum(F.col("size") - F.col("inside")).alias("outside"))


def conductance(graph: HGraph, nodes: DataFrame | Iterable) -> float:
    """Sizes of edges that cross the set of nodes, by its degrees; raises for no nodes and for all."""
    row = conductance_row(graph, nodes).first()
    if not row["volume"] or not row["outside"]:
        raise SetGraphError("the set has to hold some nodes, and not all")
    return row["cut"] / row["volume"]


def two_section(graph: HGraph, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """vertices (node) and links (src < dst, weight): pairs of nodes with the sum over common edges of w / (size - 1).

    Isolated nodes stay. weights: edge, w; by default those of the graph.
    """
    sized = graph.edge_sizes().filter("size > 1").join(weights if weights is not None else edge_weights(graph), "edge")
    shared = graph.pairs.join(sized.select("edge", (F.col("w") / (F.col("size") - 1)).alias("x")), "edge")
    a, b = shared.select("edge", F.col("node").alias("src"), "x"), shared.select("edge", F.col("node").alias("dst"))
    links = a.join(b, "edge").filter("src < dst").groupBy("src", "dst").agg(F.sum("x").alias("weight"))
    return graph.incidences.select("node").distinct(), links


def _gain_of(moves: DataFrame, parts: DataFrame, both: DataFrame, total: float) -> float:
    """By how much all moves (node, to) together raise modularity, times the total weight."""
    new = cut_lineage(parts.join(moves.select("node", "to"), "node", "left").select("node", "degree", "part", "volume", F.coalesce("to", "part").alias("to"), F.col("to").isNotNull().alias("moves")))
    a = new.select(F.col("node").alias("src"), F.col("part").alias("a"), F.col("to").alias("a_to"), F.col("moves").alias("a_moves"))
    b = new.select(F.col("node").alias("dst"), F.col("part").alias("b"), F.col("to").alias("b_to"), F.col("moves").alias("b_moves"))
    met = both.join(a, "src").join(b, "dst").filter("a_moves OR b_moves")
    same = lambda x, y: (F.col(x) == F.col(y)).cast("double")
    inside = met.agg(F.coalesce(F.sum(F.col("weight") * (same("a_to", "b_to") - same("a", "b"))), F.lit(0.0))).first()[0]
    flow = new.filter("moves").select(F.col("part").alias("p"), (-F.col("degree")).alias("x")).unionByName(new.filter("moves").select(F.col("to").alias("p"), F.col("degree").alias("x")))
    volumes = parts.groupBy(F.col("part").alias("p")).agg(F.sum("degree").alias("v"))
    changed = flow.groupBy("p").agg(F.sum("x").alias("x")).join(volumes, "p", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    spread = changed.agg(F.coalesce(F.sum((F.col("v") + F.col("x")) ** 2 - F.col("v") ** 2), F.lit(0.0))).first()[0]
    return inside - spread / total


def _settle(total: float):
    def settle(batch: pd.DataFrame) -> pd.DataFrame:
        """Moves of a block's nodes, one after another until none gains, to parts of neighbours; other blocks stand still."""
        out = []
        for block, rows in batch.groupby("block", sort=False):
            part_of = dict(zip(rows["src"], rows["own"], strict=True))
            degree = dict(zip(rows["src"], rows["degree"], strict=True))
            volume = dict(zip(rows["own"], rows["own_volume"], strict=True)) | dict(zip(rows["part"], rows["volume"], strict=True))
            inner: dict = {node: [] for node in part_of}
            outer: dict = {node: {} for node in part_of}
            for src, dst, near, part, weight in zip(rows["src"], rows["dst"], rows["inner"], rows["part"], rows["weight"], strict=True):
                if near:
                    inner[src].append((dst, weight))
                else:
                    outer[src][part] = outer[src].get(part, 0.0) + weight
            first, gained, moved = dict(part_of), 0.0, True
            while moved:
                moved = False
                for node in sorted(part_of):
                    into = dict(outer[node])
                    for dst, weight in inner[node]:
                        part = part_of[dst]
                        into[part] = into.get(part, 0.0) + weight
                    own, d = part_of[node], degree[node]
                    now = into.pop(own, 0.0) - (volume[own] - d) * d / total
                    # On ties the least part.
                    value, part = max(((w - volume[p] * d / total, p) for p, w in sorted(into.items(), reverse=True)), key=lambda x: x[0], default=(now, own))
                    if value > now + LEAST_RISE * total:
                        volume[own], volume[part], part_of[node] = volume[own] - d, volume[part] + d, part
                        gained += value - now
                        moved = True
            out += [(block, node, first[node], part, degree[node], gained) for node, part in part_of.items() if part != first[node]]
        return pd.DataFrame(out, columns=["block", "node", "part", "to", "degree", "gain"])

    return settle


def _apart(moves: DataFrame) -> DataFrame:
    """The moves of blocks no two of which touch the same part: those of greatest gain, on ties of the greatest number."""
    rank = F.struct("gain", "block")
    touched = moves.select(F.col("part").alias("p"), "block", rank.alias("rank")).unionByName(moves.select(F.col("to").alias("p"), "block", rank.alias("rank")))
    first = touched.groupBy("p").agg(F.max("rank")["block"].alias("first"))
    beaten = touched.select("p", "block").distinct().join(first, "p").filter("first <> block").select("block").distinct()
    return moves.join(beaten, "block", "left_anti")


def _moves(both: DataFrame, parts: DataFrame, total: float, most_rounds: int) -> tuple[DataFrame, bool]:
    """parts (node, part, degree, volume) after moves of single nodes to parts of neighbours, and whether there were any.

    Nodes are dealt into blocks of about BLOCK_LINKS links. A block moves its nodes one after another while the others
    stand still. What all blocks did is taken together if it is measured to raise modularity; else only blocks that touch
    different parts, whose gains add up, and the best block is always among them. So modularity rises with each round, and
    rounds end when no node gains in any block. A block holds the links among its nodes, and one row for each other part
    that a node is linked with.
    """
    blocks, any_moved = -(-both.count() // BLOCK_LINKS), False
    kind = both.schema["src"].dataType.simpleString()
    for step in range(most_rounds):
        # In turn nodes of a part are together, and nodes of any parts.
        number = F.pmod(F.xxhash64("part" if step % 2 == 0 else "node", F.lit(step)), F.lit(max(1, blocks)))
        placed = parts.withColumn("block", number)
        a = placed.select(F.col("node").alias("src"), F.col("part").alias("own"), "degree", F.col("volume").alias("own_volume"), "block")
        b = placed.select(F.col("node").alias("dst"), "part", "volume", F.col("block").alias("far"))
        inner = F.col("block") == F.col("far")
        met = both.join(a, "src").join(b, "dst").withColumn("inner", inner).withColumn("dst", F.when(inner, F.col("dst")).otherwise(F.col("src")))
        rows = met.groupBy("block", "src", "dst", "inner", "own", "degree", "own_volume", "part", "volume").agg(F.sum("weight").alias("weight"))
        found = rows.groupBy("block").applyInPandas(_settle(total), f"block long, node {kind}, part {kind}, to {kind}, degree double, gain double")
        moves = cut_lineage(found)
        if moves.isEmpty():
            return parts, any_moved
        if blocks > 1 and _gain_of(moves, parts, both, total) <= LEAST_RISE * total:
            moves = cut_lineage(_apart(moves))
        parts, any_moved = _with_volumes(parts.join(moves.select("node", "to"), "node", "left").select("node", F.coalesce("to", "part").alias("part"), "degree")), True
        if blocks == 1:
            return parts, True
    raise RuntimeError(f"moves didn't settle in {most_rounds} rounds")


def _with_volumes(parts: DataFrame) -> DataFrame:
    parts = written(parts)
    return written(parts.join(parts.groupBy("part").agg(F.sum("degree").alias("volume")), "part").select("node", "part", "degree", "volume"), parts)


def _communities(nodes: DataFrame, links: DataFrame, start: DataFrame | None = None, most_rounds: int = 1000, total: float | None = None) -> DataFrame:
    """node, part (a node of it): see louvain. total: twice the weight of the graph, of which the links may be whole components."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = written(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    degree = nodes.join(both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree")), "node", "left")
    parts = degree.withColumn("part", F.col("node")) if start is None else degree.join(start.select("node", "part"), "node")
    parts = _with_volumes(parts.select("node", "part", F.coalesce("degree", F.lit(0.0)).alias("degree")))
    total = parts.agg(F.sum("degree")).first()[0] if total is None else total
    member, level = nodes.select("node", F.col("node").alias("part")), 0
    while total:
        parts, moved = _moves(both, parts, total, most_rounds)
        if not moved and (level or start is None):
            break
        # Parts become the nodes of the next level; each level that moves has fewer.
        placed = parts.select("node", F.col("part").alias("next"))
        member = written(member.join(placed.withColumnRenamed("node", "part"), "part").select("node", F.col("next").alias("part")))
        met = both.join(placed.toDF("src", "a"), "src").join(placed.toDF("dst", "b"), "dst").filter("a <> b")
        both = written(met.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
        parts = parts.groupBy("part").agg(F.sum("degree").alias("degree")).select(F.col("part").alias("node"), "part", "degree")
        parts = written(parts.withColumn("volume", F.col("degree")))
        level += 1
    return member


def _numbered(member: DataFrame) -> DataFrame:
    return member.join(dense_index(member, "part"), "part").select("node", F.col("idx").cast("int").alias("part"))


def louvain(nodes: DataFrame, links: DataFrame, start: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """node, part: communities of a weighted graph (links src, dst, weight) by multilevel moves that raise modularity.

    Moves are joins and groupings of all nodes at once; parts then become the nodes of the next level. start (node, part;
    part a node's id) is a partition to begin with. Raises if a level doesn't settle in most_rounds.
    """
    return _numbered(_communities(nodes, links, start, most_rounds))


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(values), len(found))


def _section(edge: np.ndarray, node: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """src, dst, weight of the two-section of incidences (nodes numbered up to n) in both directions, by src."""
    order = np.lexsort((node, edge))
    edge, node, w = edge[order], node[order], w[order]
    first = np.flatnonzero(np.r_[True, edge[1:] != edge[:-1]])
    sizes = np.diff(np.r_[first, len(edge)])
    dense, keys, values, pending = np.zeros(n * n if n * n <= DENSE_PAIRS else 0), [np.empty(0, np.int64)], [np.empty(0)], 0
    for size in np.unique(sizes[sizes > 1]).tolist():
        of_size, (i, j) = first[sizes == size], np.triu_indices(size, 1)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for at in range(0, len(of_size), step):
            some = of_size[at : at + step]
            members = node[some[:, None] + np.arange(size)]
            key, value = (members[:, i] * n + members[:, j]).ravel(), np.repeat(w[some] / (size - 1), len(i))
            if len(dense):
                np.add.at(dense, key, value)
                continue
            keys.append(key)
            values.append(value)
            pending += len(key)
            if pending > PAIRS_AT_ONCE:
                keys, values = ([x] for x in _summed(keys, values))
                pending = 0
    found, weight = (np.flatnonzero(dense), dense[dense != 0]) if len(dense) else _summed(keys, values)
    src, dst = np.r_[found // n, found % n], np.r_[found % n, found // n]
    order = np.lexsort((dst, src))
    return src[order], dst[order], np.r_[weight, weight][order]


def _settled(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, degree: np.ndarray, part: np.ndarray, total: float) -> tuple[np.ndarray, bool]:
    """part after moves of nodes, one after another until none gains, to parts of neighbours, and whether there were any."""
    n, part = len(degree), part.copy()
    volume, ends = np.bincount(part, degree, n), np.searchsorted(src, np.arange(n + 1))
    any_moved, moved = False, True
    while moved:
        moved = False
        for node in range(n):
            low, high = ends[node], ends[node + 1]
            if low == high:
                continue
            own, d, near = part[node], degree[node], part[dst[low:high]]
            if n <= 8 * (high - low):
                into = np.bincount(near, weight[low:high], n)
                near = np.flatnonzero(into)
                into = into[near]
            else:
                near, at = np.unique(near, return_inverse=True)
                into = np.bincount(at, weight[low:high], len(near))
            gain = into - volume[near] * d / total
            now = into[near == own].sum() - (volume[own] - d) * d / total
            gain[near == own] = -np.inf
            best = gain.argmax() if len(gain) else 0  # on ties the least part
            if len(gain) and gain[best] > now + LEAST_RISE * total:
                volume[own], volume[near[best]], part[node] = volume[own] - d, volume[near[best]] + d, near[best]
                any_moved = moved = True
    return part, any_moved


def _search(total: float):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        """Parts of whole components, from edge, node, w and part (null: nodes on their own) of their incidences, level by level."""
        nodes, first, node = np.unique(rows["node"].to_numpy(), return_index=True, return_inverse=True)
        n, start = len(nodes), rows["part"].iloc[first]
        src, dst, weight = _section(pd.factorize(rows["edge"])[0], node, rows["w"].to_numpy(float), n)
        degree, member, level = np.bincount(src, weight, n), np.arange(n), 0
        begun = bool(start.notna().all())
        part = np.searchsorted(nodes, start.to_numpy()) if begun else member
        while len(src) and total:
            part, moved = _settled(src, dst, weight, degree, part, total)
            if not moved and (level or not begun):
                break
            # Parts become the nodes of the next level, as in _communities.
            part = np.unique(part, return_inverse=True)[1]
            n, member, degree = part.max() + 1, part[member], np.bincount(part, degree)
            a, b = part[src], part[dst]
            found, weight = _summed([(a * n + b)[a != b]], [weight[a != b]])
            src, dst, part, level = found // n, found % n, np.arange(n), level + 1
        least = np.unique(member, return_index=True)[1]
        return pd.DataFrame({"node": nodes, "part": nodes[least[member]]})

    return search


def _tasks(cells: DataFrame) -> int:
    return max(cells.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // TASK_CELLS))


def _dealt(graph: HGraph) -> tuple[DataFrame, int]:
    """edge, node, block of all incidences, and how many blocks there are; block is null in components too large for one task.

    Small components share blocks, by hash; the others that fit a task have one of their own.
    """
    cells, n = graph.pairs, F.col("n")
    # Enough tasks for what takes long with each incidence, whatever its bytes.
    cells = written(cells.repartition(_tasks(cells), "edge"))
    sized = cells.groupBy("edge").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    of_nodes = cells.groupBy("node").agg(F.lit(0).alias("n"))
    counts = (F.sum("n").alias("cells"), F.sum(n * (n - 1) / 2).alias("pairs"))
    whole = sized.agg(*counts).crossJoin(of_nodes.agg(F.count("*").alias("nodes")))
    links = F.least(F.col("pairs"), F.col("nodes") * (F.col("nodes") - 1) / 2)
    fits = (F.col("cells") <= WHOLE_CELLS) & (F.col("pairs") <= WHOLE_PAIRS) & (links <= WHOLE_LINKS)
    if whole.select(fits).first()[0] is not False:
        return cells.withColumn("block", F.lit(0).cast("long")), 1
    labels = cut_lineage(component_labels(graph.of(cells.withColumn("weight", F.lit(1.0)).withColumn("misc", F.lit(None).cast("map<string,string>"))), 1, False))
    of_edges = sized.join(labels.withColumnRenamed("id", "node"), "node").groupBy("component").agg(*counts)
    kinds = cut_lineage(labels.groupBy("component").agg(F.count("*").alias("nodes")).join(of_edges, "component"))
    small = (F.col("cells") <= WHOLE_CELLS / 8) & (F.col("pairs") <= WHOLE_PAIRS / 8) & (links <= WHOLE_LINKS / 8)
    sums = kinds.filter(fits).groupBy(small.alias("small")).agg(F.count("*").alias("n"), F.sum("cells").alias("cells"), F.sum("pairs").alias("pairs"), F.sum(links).alias("links")).collect()
    shared = max((math.ceil(max(4 * r["cells"] / WHOLE_CELLS, 4 * r["pairs"] / WHOLE_PAIRS, 4 * r["links"] / WHOLE_LINKS)) for r in sums if r["small"]), default=0)
    hashed = F.xxhash64("component")
    block = F.when(fits & small, F.pmod(hashed, F.lit(max(1, shared)))).when(fits, hashed)
    placed = labels.join(kinds.select("component", block.alias("block")), "component").select(F.col("id").alias("node"), "block")
    return written(cells.join(placed, "node").select("edge", "node", "block").repartition(_tasks(cells), "edge"), cells), shared + sum(r["n"] for r in sums if not r["small"])


def kumar(graph: HGraph, delta: float = 0.01, most_rounds: int = 50) -> DataFrame:
    """node, part: communities of the two-section, whose edge weights are moved towards edges that parts hold whole.

    Each round begins with the partition before it. Weights settle by halves once parts do; raises if a weight still
    changes by more than delta after most_rounds. No node moves between components, so blocks of components that fit a
    task are searched side by side, from their incidences; only the others' two-section is made as a table, for louvain.
    """
    graph = replace(graph, incidences=written(graph.incidences))
    weights = written(edge_weights(graph))
    n_edges = weights.count()
    cells, blocks = _dealt(graph)
    sizes = cells.groupBy("edge").agg(F.count("*").alias("size"))
    kind = cells.schema["node"].dataType.simpleString()
    whole = cells.filter("block IS NOT NULL")
    large = graph.of(cells.filter("block IS NULL").select("edge", "node", F.lit(1.0).alias("weight"), F.lit(None).cast("map<string,string>").alias("misc")))
    any_large, large_nodes = not large.incidences.isEmpty(), large.incidences.select("node").distinct()

    def search(weights: DataFrame, total: float, parts: DataFrame | None = None) -> DataFrame:
        rows = whole.join(weights, "edge")
        rows = rows.withColumn("part", F.lit(None).cast(kind)) if parts is None else rows.join(parts, "node")
        # Blocks are few and take long: each of them gets a task, whatever its bytes.
        found = rows.select("block", "edge", "node", "w", "part").repartition(max(1, 4 * blocks), "block").groupBy("block").applyInPandas(_search(total), f"node {kind}, part {kind}")
        if any_large:
            found = found.unionByName(_communities(large_nodes, two_section(large, weights)[1], parts, total=total))
        return written(found)

    total = sizes.filter("size > 1").join(weights, "edge").agg(F.coalesce(F.sum(F.col("w") * F.col("size")), F.lit(0.0))).first()[0]
    parts = search(weights, total)
    for _ in range(most_rounds + 1):
        k = parts.select("part").distinct().count()
        held = cells.join(parts, "node").groupBy("edge", "part").agg(F.count("*").alias("c"))
        # A part that holds no node of an edge adds 1 / (1 + 0).
        per = held.groupBy("edge").agg(F.sum("c").alias("size"), (F.sum(1 / (1 + F.col("c"))) + k - F.count("*")).alias("s"))
        new = written(per.join(weights, "edge").select("edge", "size", (F.col("w") / 2 + F.col("s") * (F.col("size") + k) / n_edges / 2).alias("v"), "w"))
        change = F.coalesce(F.max(F.abs(F.col("v") - F.col("w"))), F.lit(0.0))
        difference, total = new.agg(change, F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("v") * F.col("size"))), F.lit(0.0))).first()
        weights = new.select("edge", F.col("v").alias("w"))
        parts = search(weights, total, parts)
        if difference <= delta:
            return _numbered(parts)
    raise RuntimeError(f"edge weights didn't settle in {most_rounds} rounds")


def _expected(sizes: list, whole: float):
    """A column function: the weight within majorities that chance gives a part of a volume. sizes: (d, c, weight by the rule)."""
    d, c, v = (np.array([r[i] for r in sizes], float) for i in range(3))
    choices = np.array([math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in zip(d, c, strict=True)])

    @F.pandas_udf("double")
    def expected(volume: pd.Series) -> pd.Series:
        p = np.clip(volume.to_numpy(float) / whole, 1e-300, 1 - 1e-16)[:, None]
        hit, miss, out = np.log(p), np.log1p(-p), np.zeros(len(p))
        step = max(1, GRID // max(1, len(p)))
        for at in range(0, len(v), step):
            some = slice(at, at + step)
            out += (v[some] * np.exp(choices[some] + c[some] * hit + (d - c)[some] * miss)).sum(1)
        return pd.Series(out)

    return expected


def _with_chance(options: DataFrame, sizes: DataFrame, whole: float) -> DataFrame:
    """options with chance: what a move changes in the weight that chance gives its two parts.

    It depends on the volumes and the strength of the node alone, and so is worked out once for each different volume. If
    there are at most MOST_VOLUMES these go to every task and meet the sizes of edges there, else the sizes do, up to MOST_TERMS.
    """
    options = cut_lineage(options)
    moves = cut_lineage(options.select("volume", "s", "own_volume").distinct())
    volumes = (F.col("volume") + F.col("s"), F.col("volume"), F.col("own_volume") - F.col("s"), F.col("own_volume"))
    values = cut_lineage(moves.select(F.explode(F.array(*volumes)).alias("vol")).distinct())
    if values.count() <= MOST_VOLUMES:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("vol") / whole))
        met = sizes.join(F.broadcast(values), F.lit(True)).groupBy("vol").agg(F.sum(F.col("v") * binomial(F.col("c"), F.col("d"), p)).alias("x"))
        for name, volume in zip(("new", "old", "own_new", "own_old"), volumes, strict=True):
            moves = moves.withColumn("_vol", volume).join(met.toDF("_vol", name), "_vol", "left").drop("_vol").withColumn(name, F.coalesce(name, F.lit(0.0)))
        moves = moves.select("volume", "s", "own_volume", (F.col("new") - F.col("old") + F.col("own_new") - F.col("own_old")).alias("chance"))
    else:
        expected = _expected(bounded_rows(sizes, MOST_TERMS, f"sizes of edges, of moves with more than {MOST_VOLUMES} volumes"), whole)
        moves = moves.withColumn("chance", expected(volumes[0]) - expected(volumes[1]) + expected(volumes[2]) - expected(volumes[3]))
    return options.join(moves, ["volume", "s", "own_volume"])


def last_step(graph: HGraph, parts: DataFrame | Mapping | Iterable[Iterable], wdc: Callable[[Column, Column], Column] = linear, delta: float = 0.01, most_rounds: int = 50) -> DataFrame:
    """node, part: nodes are moved to the part of a neighbour that raises modularity most, while that gains enough.

    In every round each node finds its best move, and those move whose gain is the greatest in all of their edges; so
    no two moves of a round meet in an edge. What chance gives each part is taken from before the round.
    """
    weights = cut_lineage(edge_weights(graph))
    sized = graph.edge_sizes().join(weights, "edge")
    sizes = sized.groupBy(F.col("size").alias("d")).agg(F.sum("w").alias("n"))
    sizes = sizes.withColumn("c", F.explode(F.sequence(F.floor(F.col("d") / 2) + 1, F.col("d"))))
    sizes = cut_lineage(sizes.select("d", "c", (F.col("n") * wdc(F.col("d"), F.col("c"))).alias("v")).repartition(graph.spark.sparkContext.defaultParallelism * 4))
    total, whole = sized.agg(F.sum("w"), F.sum(F.col("w") * F.col("size"))).first()
    strength = cut_lineage(graph.pairs.join(weights, "edge").groupBy("node").agg(F.sum("w").alias("s")))
    held = lambda c: F.when(c > F.col("d") / 2, wdc(F.col("d"), c)).otherwise(0.0)
    parts = cut_lineage(part_table(graph, parts))
    for _ in range(most_rounds):
        placed = graph.pairs.join(parts, "node")
        counts = cut_lineage(placed.groupBy("edge", "part").agg(F.count("*").alias("c")))
        edges = counts.groupBy("edge").agg(F.sum("c").alias("d"), F.max(F.struct("c", "part")).alias("top")).join(weights, "edge")
        leaving = F.when(F.col("top.part") == F.col("part"), held(F.col("top.c") - 1)).otherwise(held(F.col("top.c")))
        cells = cut_lineage(placed.join(edges, "edge").select("edge", "node", F.col("part").alias("own"), "d", "w", leaving.alias("gone"), held(F.col("top.c")).alias("now")))
        lost = cells.groupBy("node", "own").agg(F.sum(F.col("w") * (F.col("gone") - F.col("now"))).alias("lost"))
        met = cells.join(counts, "edge").filter("part <> own")
        joined = F.when(F.col("c") + 1 > F.col("d") / 2, held(F.col("c") + 1)).otherwise(F.col("gone"))
        won = met.groupBy("node", "part").agg(F.sum(F.col("w") * (joined - F.col("gone"))).alias("won"))
        volume = parts.join(strength, "node").groupBy("part").agg(F.sum("s").alias("volume"))
        options = won.join(lost, "node").join(strength, "node").join(volume, "part").join(volume.toDF("own", "own_volume"), "own")
        best = _with_chance(options, sizes, whole).withColumn("gain", F.col("won") + F.col("lost") - F.col("chance")).filter(F.col("gain") > LEAST_GAIN)
        best = cut_lineage(best.groupBy("node").agg(F.max(F.struct("gain", "part")).alias("best")).select("node", "best.gain", F.col("best.part").alias("to")))
        ranked = graph.pairs.join(best, "node")
        first = ranked.groupBy("edge").agg(F.max(F.struct("gain", "node")).alias("first"))
        moves = ranked.join(first, "edge").groupBy("node").agg(F.min(F.col("first.node") == F.col("node")).alias("wins")).filter("wins")
        moves = cut_lineage(moves.join(best, "node").select("node", "to", "gain"))
        gained = moves.agg(F.coalesce(F.sum("gain"), F.lit(0.0))).first()[0]
        parts = written(parts.join(moves, "node", "left").select("node", F.coalesce("to", "part").alias("part")), parts)
        if gained / total < delta:
            return parts
    raise RuntimeError(f"moves still gain after {most_rounds} rounds")
