"""Matchings: sets of edges without common nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NonUniformError, SetGraphError, TooLargeError
from ..graph import HGraph
from ..plans.lineage import cut_lineage


def edge_tuple(graph: HGraph) -> DataFrame:
    """edge, nodes: each edge as its sorted nodes."""
    return graph.elements()


def uniform_size(graph: HGraph) -> int:
    """The size of all edges; raises if there are several."""
    sizes = [r[0] for r in graph.edge_sizes().select("size").distinct().take(2)]
    if len(sizes) > 1:
        raise NonUniformError("edges have different sizes")
    return sizes[0] if sizes else 0


def maximal_matching(graph: HGraph, rank: Column | None = None, most_rounds: int = 10_000) -> DataFrame:
    """edge: the matching that takes edges in the order of rank (by default of their ids) where they still fit.

    In rounds: an edge of least rank at each of its nodes is taken, then edges that touch it fall out. That gives
    just what taking them one after the other would.
    """
    ranked = F.struct((F.col("edge") if rank is None else rank).alias("r"), F.col("edge").alias("e"))
    alive = cut_lineage(graph.incidences.select("edge", "node", ranked.alias("_rank")))
    taken = alive.select("edge").limit(0)
    for _ in range(most_rounds):
        if alive.isEmpty():
            return taken
        first = alive.groupBy("node").agg(F.min("_rank").alias("_first"))
        seen = alive.join(first, "node").groupBy("edge").agg(F.min(F.col("_rank") == F.col("_first")).alias("wins"))
        won = cut_lineage(seen.filter("wins").select("edge"))
        gone = alive.join(alive.join(won, "edge", "left_semi").select("node").distinct(), "node", "left_semi").select("edge").distinct()
        taken = cut_lineage(taken.unionByName(won))
        alive = cut_lineage(alive.join(gone, "edge", "left_anti"))
    raise SetGraphError(f"the matching didn't settle in {most_rounds} rounds")


def partition_hypergraph(graph: HGraph, k: int, seed: int = 0) -> DataFrame:
    """edge, part: every edge in one of k parts, by a hash of its id and the seed."""
    return graph.incidences.select("edge").distinct().withColumn("part", F.pmod(F.xxhash64("edge", F.lit(seed)), F.lit(k)).cast("int"))


def greedy_matching(graph: HGraph, k: int, seed: int = 0) -> DataFrame:
    """edge: a maximal matching within each of k random parts, merged greedily by part, then id.

    All parts are matched at once: an edge's nodes are told apart by part.
    """
    uniform_size(graph)
    parts = partition_hypergraph(graph, k, seed)
    split = graph.pairs.join(parts, "edge").select("edge", F.concat_ws(":", "part", F.col("node").cast("string")).alias("node"))
    within = maximal_matching(HGraph.of(split))
    chosen = graph.pairs.join(within, "edge", "left_semi").join(parts, "edge")
    return maximal_matching(HGraph.of(chosen), rank=F.col("part"))


def sample_edges(graph: HGraph, p: float, seed: int = 0) -> HGraph:
    """Every edge stays with probability p."""
    kept = graph.incidences.select("edge").distinct().filter(F.pmod(F.xxhash64("edge", F.lit(seed), F.lit("sample")), F.lit(1 << 40)) < F.lit(int(p * (1 << 40))))
    return HGraph.of(graph.incidences.join(kept, "edge", "left_semi").select(*graph.incidences.columns), graph.default_cell_weight, graph.name)


def sampling_round(graph: HGraph, p: float, s: int, seed: int = 0) -> tuple[DataFrame | None, HGraph]:
    """The maximal matching of a sample with at most s edges (None for a larger one), and the sample."""
    sample = sample_edges(graph, p, seed)
    if sample.dimensions()[0] > s:
        return None, sample
    return maximal_matching(sample), sample


def iterated_sampling(graph: HGraph, s: int, max_iterations: int = 100, seed: int = 0) -> DataFrame:
    """edge: matchings of samples of about s / (5 d) edges of size d, one after the other among the edges still free, until
    none is left. Up to s edges are one sample. Raises where a sample has more than s edges.

    Every edge is in one sample, and a maximal matching by number of sample is what matching the samples in turn gives; so
    all samples are matched at once, and how many there are, which grows with the graph, doesn't count as rounds.
    max_iterations bounds the rounds of that matching, 100 times over.
    """
    d, m = uniform_size(graph), graph.dimensions()[0]
    if m <= s:
        return cut_lineage(maximal_matching(graph, most_rounds=max_iterations * 100))
    if s < 1:
        raise TooLargeError(f"a sample has more than {s} edges")
    sample = F.pmod(F.xxhash64("edge", F.lit(seed), F.lit("sample")), F.lit(-(-5 * m * d // s)))
    if not graph.incidences.select("edge").distinct().groupBy(sample.alias("sample")).count().filter(F.col("count") > s).isEmpty():
        raise TooLargeError(f"a sample has more than {s} edges")
    return cut_lineage(maximal_matching(graph, rank=sample, most_rounds=max_iterations * 100))


def check_beta_condition(beta: float, beta_minus: float, d: int) -> bool:
    return beta - beta_minus >= d - 1


def build_HEDCS(graph: HGraph, beta: float, beta_minus: float, most_rounds: int = 1000) -> HGraph:  # noqa: N802
    """A subgraph in which the degrees of an edge's nodes sum up to beta at most, and to beta_minus at least for every
    edge left out. In rounds: of the edges that break a bound, those first among the ones they meet are changed."""
    if not check_beta_condition(beta, beta_minus, uniform_size(graph)):
        raise SetGraphError("beta has to exceed beta_minus by the size of edges less one")
    # Rounds read what is written here, not what the graph was made from.
    state = cut_lineage(graph.pairs.withColumn("in", F.lit(True)))
    for _ in range(most_rounds):
        degrees = state.groupBy("node").agg(F.count(F.when(F.col("in"), 1)).alias("degree"))
        total = state.join(degrees, "node").groupBy("edge", "in").agg(F.sum("degree").alias("total"))
        wrong = total.filter((F.col("in") & (F.col("total") > beta)) | (~F.col("in") & (F.col("total") < beta_minus)))
        wrong = cut_lineage(wrong.select("edge"))
        if wrong.isEmpty():
            return HGraph.of(graph.incidences.join(state.filter("in"), "edge", "left_semi").select(*graph.incidences.columns), graph.default_cell_weight, graph.name)
        change = maximal_matching(HGraph.of(state.select("edge", "node").join(wrong, "edge", "left_semi"))).withColumn("_turn", F.lit(True))
        state = cut_lineage(state.join(change, "edge", "left").select("edge", "node", F.when(F.col("_turn"), ~F.col("in")).otherwise(F.col("in")).alias("in")))
    raise SetGraphError(f"the subgraph didn't settle in {most_rounds} rounds")


def HEDCS_matching(graph: HGraph, s: int, beta: float | None = None, beta_minus: float | None = None, seed: int = 0) -> DataFrame:  # noqa: N802
    """edge: the maximal matching of the union of the degree-constrained subgraphs of random parts of about s edges."""
    graph = HGraph.of(cut_lineage(graph.incidences), graph.default_cell_weight, graph.name)
    d = uniform_size(graph)
    n, m = graph.shape
    k = max(1, -(-m // max(1, s)))
    beta = 500.0 * d**3 * max(n, 2) if beta is None else beta
    beta_minus = beta - (d - 1) if beta_minus is None else beta_minus
    if not check_beta_condition(beta, beta_minus, d):
        raise SetGraphError("beta has to exceed beta_minus by the size of edges less one")
    if beta >= m * d:  # no edge can reach the bound, so every part is its own subgraph
        return maximal_matching(graph)
    parts = partition_hypergraph(graph, k, seed)
    split = graph.pairs.join(parts, "edge").select("edge", F.concat_ws(":", "part", F.col("node").cast("string")).alias("node"))
    kept = build_HEDCS(HGraph.of(split), beta, beta_minus).incidences.select("edge").distinct()
    return maximal_matching(HGraph.of(graph.incidences.join(kept, "edge", "left_semi").select(*graph.incidences.columns)))


def approximation_matching_checking(optimal: DataFrame, approx: DataFrame) -> bool:
    """Whether every edge of one matching shares a node with an edge of the other; both are tables (edge, node)."""
    met = optimal.join(approx.select("node").distinct(), "node", "left_semi").select("edge").distinct()
    return optimal.select("edge").distinct().join(met, "edge", "left_anti").isEmpty()
