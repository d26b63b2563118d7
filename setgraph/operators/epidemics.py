"""Epidemics on hypergraphs, in synchronous steps and in leaps of continuous time, as tables.

A transmission rule is a function of two columns, the size of an edge and how many others in it are infected
(setgraph.functions.rules). Random numbers are hashes of seed, step and ids, so a run can be repeated, and a lost task
draws the same numbers again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SetGraphError
from ..functions.rules import threshold
from ..graph import HGraph, id_table
from ..plans.lineage import cut_lineage

def _uniform(*parts) -> Column:
    """A number from 0 to 1 that depends on its parts."""
    return (F.pmod(F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), F.lit(1 << 50)) + 0.5) / (1 << 50)


def initial_status(graph: HGraph, initial_infecteds: Iterable | None = None, initial_recovereds: Iterable | None = None, rho: float | None = None, seed: int = 0) -> DataFrame:
    """node, status: given nodes are infected (I) or recovered (R), else a share rho, else one at random; others are S."""
    if rho is not None and initial_infecteds is not None:
        raise SetGraphError("give either initial_infecteds or rho")
    nodes = graph.incidences.select("node").distinct()
    kind = graph.incidences.schema["node"].dataType
    if initial_infecteds is None:
        n = 1 if rho is None else round(graph.order() * rho)
        infected = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n)
    else:
        infected = id_table(graph.spark, initial_infecteds, kind, "node")
    recovered = id_table(graph.spark, initial_recovereds or [], kind, "node")
    marked = nodes.join(infected.withColumn("_i", F.lit(True)), "node", "left").join(recovered.withColumn("_r", F.lit(True)), "node", "left")
    return marked.select("node", F.when(F.col("_r"), "R").when(F.col("_i"), "I").otherwise("S").alias("status"))


def infected_others(graph: HGraph, status: DataFrame) -> DataFrame:
    """edge, size, infected: how many nodes of each edge are infected."""
    placed = graph.pairs.join(status, "node")
    return placed.groupBy("edge").agg(F.count("*").alias("size"), F.count(F.when(F.col("status") == "I", 1)).alias("infected"))


def transmission(graph: HGraph, status: DataFrame, rule: Callable[..., Column] = threshold, **args) -> DataFrame:
    """edge, node, size, force: the rule for every susceptible node and each of its edges."""
    edges = infected_others(graph, status)
    susceptible = graph.pairs.join(status.filter("status = 'S'").select("node"), "node")
    return susceptible.join(edges, "edge").select("edge", "node", "size", rule(F.col("size"), F.col("infected"), **args).cast("double").alias("force"))


def _rates(tau: Mapping[int, float]) -> Column:
    return F.coalesce(*(F.when(F.col("size") == d, F.lit(float(x))) for d, x in tau.items()), F.lit(0.0))


def _held(graph: HGraph) -> HGraph:
    """The incidences written once, as every step reads them."""
    return HGraph.of(cut_lineage(graph.pairs))


def _discrete(graph, tau, gamma, rule, status, tmin, tmax, dt, seed, back_to, full, args, most_steps, leaps=False):
    status = cut_lineage(status)
    counts = _counts(status)
    chance = (lambda rate: 1 - F.exp(-rate * dt)) if leaps else (lambda rate: rate * dt)
    trace, events, t, step = [(float(tmin), *counts)], [status.filter("status <> 'S'").select(F.lit(float(tmin)).alias("t"), "status", "node", F.lit(None).cast(graph.incidences.schema["edge"].dataType).alias("edge"))], tmin, 0
    while t < tmax and counts[1] and step < most_steps:
        force = transmission(graph, status, rule, **args)
        hit = _uniform(seed, step, "infect", F.col("node"), F.col("edge")) <= chance(_rates(tau) * F.col("force"))
        infected = force.filter(hit).groupBy("node").agg(F.min("edge").alias("by"))
        healed = _uniform(seed, step, "heal", F.col("node")) <= chance(F.lit(float(gamma)))
        moved = status.join(infected, "node", "left")
        new = F.when((F.col("status") == "I") & healed, back_to).when((F.col("status") == "S") & F.col("by").isNotNull(), "I").otherwise(F.col("status"))
        moved = cut_lineage(moved.select("node", new.alias("new"), "status", "by"))
        t, step = t + dt, step + 1
        if full:
            events.append(moved.filter("new <> status").select(F.lit(float(t)).alias("t"), F.col("new").alias("status"), "node", F.col("by").alias("edge")))
        status = moved.select("node", F.col("new").alias("status"))
        counts = _counts(status)
        trace.append((float(t), *counts))
    if full:
        out = events[0]
        for e in events[1:]:
            out = out.unionByName(e)
        return out
    columns = "t double, S long, I long, R long"
    found = graph.spark.createDataFrame(trace, columns)
    return found.drop("R") if back_to == "S" else found


def _counts(status: DataFrame) -> tuple[int, int, int]:
    found = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    return found.get("S", 0), found.get("I", 0), found.get("R", 0)


def discrete_SIR(  # noqa: N802
    graph: HGraph, tau: Mapping[int, float], gamma: float, transmission_function: Callable[..., Column] = threshold, initial_infecteds=None,
    initial_recovereds=None, rho=None, tmin: float = 0, tmax: float = float("inf"), dt: float = 1.0, return_full_data: bool = False, seed: int = 0, most_steps: int = 10_000, **args,
) -> DataFrame:
    """t, S, I, R by synchronous steps (or the events t, status, node, edge): an infected node recovers with
    probability gamma dt, a susceptible one is infected through an edge of size d with probability tau[d] rule dt."""
    graph = _held(graph)
    status = initial_status(graph, initial_infecteds, initial_recovereds, rho, seed)
    return _discrete(graph, tau, gamma, transmission_function, status, tmin, tmax, dt, seed, "R", return_full_data, args, most_steps)


def discrete_SIS(  # noqa: N802
    graph: HGraph, tau: Mapping[int, float], gamma: float, transmission_function: Callable[..., Column] = threshold, initial_infecteds=None,
    rho=None, tmin: float = 0, tmax: float = 100, dt: float = 1.0, return_full_data: bool = False, seed: int = 0, most_steps: int = 10_000, **args,
) -> DataFrame:
    """t, S, I: as discrete_SIR, but infected nodes become susceptible again."""
    graph = _held(graph)
    status = initial_status(graph, initial_infecteds, None, rho, seed)
    return _discrete(graph, tau, gamma, transmission_function, status, tmin, tmax, dt, seed, "S", return_full_data, args, most_steps)


def Gillespie_SIR(  # noqa: N802
    graph: HGraph, tau: Mapping[int, float], gamma: float, transmission_function: Callable[..., Column] = threshold, initial_infecteds=None,
    initial_recovereds=None, rho=None, tmin: float = 0, tmax: float = float("inf"), dt: float = 0.1, return_full_data: bool = False, seed: int = 0, most_steps: int = 10_000, **args,
) -> DataFrame:
    """t, S, I, R in continuous time, by leaps: for dt all rates stay what they are, and what happens at rate r happens
    with probability 1 - exp(-r dt). The whole graph takes a leap at once; the smaller dt, the nearer to single events."""
    graph = _held(graph)
    status = initial_status(graph, initial_infecteds, initial_recovereds, rho, seed)
    return _discrete(graph, tau, gamma, transmission_function, status, tmin, tmax, dt, seed, "R", return_full_data, args, most_steps, leaps=True)


def Gillespie_SIS(  # noqa: N802
    graph: HGraph, tau: Mapping[int, float], gamma: float, transmission_function: Callable[..., Column] = threshold, initial_infecteds=None,
    rho=None, tmin: float = 0, tmax: float = 100, dt: float = 0.1, return_full_data: bool = False, seed: int = 0, most_steps: int = 10_000, **args,
) -> DataFrame:
    """t, S, I: as Gillespie_SIR, but infected nodes become susceptible again."""
    graph = _held(graph)
    status = initial_status(graph, initial_infecteds, None, rho, seed)
    return _discrete(graph, tau, gamma, transmission_function, status, tmin, tmax, dt, seed, "S", return_full_data, args, most_steps, leaps=True)
