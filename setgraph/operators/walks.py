"""Random walks on hypergraphs: transition matrix, stationary distribution, Laplacian, spectral clusters."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SetGraphError
from ..graph import HGraph
from ..plans.lineage import written
from .connectivity import is_connected


def prob_trans(graph: HGraph, weights: bool = False, check_connected: bool = True) -> DataFrame:
    """src, dst, p: from a node an edge is drawn by 1 + the standard deviation of its cell weights, then one of its
    nodes (the first one included) by cell weight. Without weights all cells weigh the same."""
    if check_connected and not is_connected(graph):
        raise SetGraphError("the graph isn't connected")
    cell = F.col("weight") if weights else F.lit(1.0)
    cells = graph.incidences.select("edge", "node", cell.alias("gamma"))
    edges = cells.groupBy("edge").agg((1 + F.stddev_pop("gamma")).alias("score"), F.sum("gamma").alias("total"))
    scored = cells.join(edges, "edge")
    leave = scored.groupBy("node").agg(F.sum("score").alias("leave"))
    out = scored.select("edge", F.col("node").alias("src"), "score").join(leave.withColumnRenamed("node", "src"), "src")
    into = scored.select("edge", F.col("node").alias("dst"), (F.col("gamma") / F.col("total")).alias("share"))
    return out.join(into, "edge").groupBy("src", "dst").agg(F.sum(F.col("score") / F.col("leave") * F.col("share")).alias("p"))


def get_pi(transitions: DataFrame, tolerance: float = 1e-12, most_rounds: int = 1000) -> DataFrame:
    """id, pi: the stationary distribution of a transition matrix (src, dst, p), by power iteration of the walk that
    stays where it is with probability 1/2 (which has the same one, and converges where the walk alternates)."""
    transitions = transitions.persist()
    ids = transitions.select(F.col("src").alias("id")).distinct()
    n = ids.count()
    pi = written(ids.withColumn("pi", F.lit(1.0 / max(n, 1))))
    for _ in range(most_rounds):
        step = transitions.join(pi, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("p") * F.col("pi")).alias("in"))
        new = pi.join(step, F.col("id") == F.col("dst"), "left").select("id", ((F.col("pi") + F.coalesce("in", F.lit(0.0))) / 2).alias("new"), "pi")
        new = written(new)
        change = new.agg(F.coalesce(F.sum(F.abs(F.col("new") - F.col("pi"))), F.lit(0.0))).first()[0]
        pi = new.select("id", F.col("new").alias("pi"))
        if change < tolerance:
            break
    transitions.unpersist()
    return pi


def stationary(graph: HGraph) -> DataFrame:
    """id, pi of the unweighted walk: in proportion to degree."""
    degrees = graph.node_degrees()
    total = graph.incidences.count()
    return degrees.select(F.col("node").alias("id"), (F.col("degree") / F.lit(total)).alias("pi"))


def norm_lap(graph: HGraph, weights: bool = False, check_connected: bool = True) -> DataFrame:
    """row, col, value of I - (Pi^1/2 P Pi^-1/2 + its transpose) / 2; zeros are left out.

    Without weights it is 1 on the diagonal less the sum over common edges of 1 / (size sqrt(degree degree)); pairs of
    nodes are met once, and mirrored.
    """
    if check_connected and not is_connected(graph):
        raise SetGraphError("the graph isn't connected")
    if not weights:
        shared = graph.pairs.join(graph.edge_sizes(), "edge").select("edge", "node", (1 / F.col("size")).alias("x"))
        nodes = shared.groupBy("node").agg(F.count("*").alias("degree"), F.sum("x").alias("own"))
        a, b = shared.select("edge", F.col("node").alias("row"), "x"), shared.select("edge", F.col("node").alias("col"))
        met = a.join(b, "edge").filter("row < col").groupBy("row", "col").agg(F.sum("x").alias("x"))
        met = met.join(nodes.select(F.col("node").alias("row"), F.col("degree").alias("d_row")), "row").join(nodes.select(F.col("node").alias("col"), F.col("degree").alias("d_col")), "col")
        half = met.select("row", "col", (-F.col("x") / F.sqrt(F.col("d_row") * F.col("d_col"))).alias("value"))
        diagonal = nodes.select(F.col("node").alias("row"), F.col("node").alias("col"), (1 - F.col("own") / F.col("degree")).alias("value"))
        return diagonal.unionByName(half).unionByName(half.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")).filter(F.abs("value") > 1e-15)
    p = prob_trans(graph, weights=True, check_connected=False)
    pi = get_pi(p)
    half = p.join(pi.toDF("src", "pi_src"), "src").join(pi.toDF("dst", "pi_dst"), "dst")
    half = half.select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.sqrt(F.col("pi_src") / F.col("pi_dst")) * F.col("p") / 2).alias("value"))
    off = half.unionByName(half.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    ids = graph.incidences.select(F.col("node").alias("row")).distinct()
    diagonal = ids.select("row", F.col("row").alias("col"), F.lit(1.0).alias("value"))
    return diagonal.unionByName(off).groupBy("row", "col").agg(F.sum("value").alias("value")).filter(F.abs("value") > 1e-15)


def spec_clus(graph: HGraph, k: int, existing_lap: DataFrame | None = None, weights: bool = False, seed: int = 0, rounds: int = 30) -> DataFrame:
    """node, cluster: k-means of the rows of the k leading eigenvectors of I - L, found by orthogonal
    iteration: over the incidences for the unweighted Laplacian, which isn't made then, else over its table."""
    if existing_lap is None and not weights:
        if not is_connected(graph):
            raise SetGraphError("the graph isn't connected")
        ids, apply = _through_incidences(graph)
    else:
        lap = (norm_lap(graph, weights) if existing_lap is None else existing_lap).persist()
        ids, apply = lap.select(F.col("row").alias("id")).distinct(), _by_table(lap)
    k = min(k, ids.count())
    embedded = _orthogonal_iteration(apply, ids, k, seed, rounds)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = embedded.select("id", array_to_vector(F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v"))).alias("features"))
    found = KMeans(k=k, seed=seed).fit(rows).transform(rows)
    return found.select(F.col("id").alias("node"), F.col("prediction").alias("cluster"))


def _by_table(lap: DataFrame):
    """(vectors, k) -> row, s0, s1, ...: the Laplacian, a table (row, col, value), times k vectors (id, v)."""

    def apply(vectors: DataFrame, k: int) -> DataFrame:
        step = lap.join(vectors.withColumnRenamed("id", "col"), "col")
        return step.groupBy("row").agg(*(F.sum(F.col("value") * F.col("v")[j]).alias(f"s{j}") for j in range(k)))

    return apply


def _through_incidences(graph: HGraph):
    """The nodes (id), and what _by_table gives for norm_lap without weights: vectors go to the edges as means and back."""
    cells = written(graph.pairs)
    degrees = written(cells.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree")))

    def apply(vectors: DataFrame, k: int) -> DataFrame:
        own = vectors.join(degrees, "id")
        sent = own.select(F.col("id").alias("node"), *((F.col("v")[j] / F.sqrt("degree")).alias(f"x{j}") for j in range(k)))
        means = cells.join(sent, "node").groupBy("edge").agg(*(F.avg(f"x{j}").alias(f"x{j}") for j in range(k)))
        came = cells.join(means, "edge").groupBy(F.col("node").alias("id")).agg(*(F.sum(f"x{j}").alias(f"x{j}") for j in range(k)))
        return own.join(came, "id").select(F.col("id").alias("row"), *((F.col("v")[j] - F.col(f"x{j}") / F.sqrt("degree")).alias(f"s{j}") for j in range(k)))

    return degrees.select("id"), apply


def _orthogonal_iteration(apply, ids: DataFrame, k: int, seed: int, rounds: int) -> DataFrame:
    """Leading eigenvectors of 2I - L, which has those of I - L in the same order and no negative ones."""
    vectors = written(ids.select("id", F.array(*(F.randn(seed + j) for j in range(k))).alias("v")))
    for _ in range(rounds):
        before = vectors
        gram = np.array(vectors.agg(*(F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(k) for j in range(k))).first()).reshape(k, k)
        back = np.linalg.inv(np.linalg.cholesky(gram)).T
        vectors = vectors.select("id", F.array(*(sum((F.col("v")[i] * float(back[i, j]) for i in range(k)), F.lit(0.0)) for j in range(k))).alias("v"))
        vectors = vectors.join(apply(vectors, k), F.col("id") == F.col("row")).select("id", F.array(*(2 * F.col("v")[j] - F.col(f"s{j}") for j in range(k))).alias("v"))
        vectors = written(vectors, before)
    return vectors
