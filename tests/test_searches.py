"""Communities, side-by-side searches, dense numbers, hubs of components and callables, against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from setgraph.functions import properties
from setgraph.graph import HGraph
from setgraph.operators import communities, components, distances, pairs
from setgraph.sources import collections as build


def random_links(rng, n, p, offset=0):
    return [(offset + i, offset + j) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def modularity_by_hand(links, part):
    total = 2 * sum(w for _, _, w in links)
    degree = defaultdict(float)
    for a, b, w in links:
        degree[a] += w
        degree[b] += w
    volume = defaultdict(float)
    for node, d in degree.items():
        volume[part[node]] += d
    return sum(2 * w for a, b, w in links if part[a] == part[b]) / total - sum((v / total) ** 2 for v in volume.values())


@pytest.mark.parametrize("block_links", [15, 10_000])
def test_louvain_finds_planted_groups(spark, block_links, monkeypatch):
    """Three dense groups with few links between them, in one block and in many; no single move gains in the result."""
    monkeypatch.setattr(communities, "BLOCK_LINKS", block_links)
    rng = random.Random(4)
    links = [(a, b, 1.0) for k in range(3) for a, b in random_links(rng, 7, 0.9, 10 * k)] + [(0, 10, 1.0), (11, 20, 1.0), (1, 21, 1.0)]
    nodes = sorted({x for a, b, _ in links for x in (a, b)} | {99})
    frame = spark.createDataFrame(links, "src long, dst long, weight double")
    found = {r["node"]: r["part"] for r in communities.louvain(spark.createDataFrame([(n,) for n in nodes], "node long"), frame).collect()}
    assert {frozenset(n for n in nodes if found[n] == p) for p in found.values()} == {frozenset(n for n in nodes if n // 10 == k) for k in (0, 1, 2, 9)}
    best = modularity_by_hand(links, found)
    for node in nodes[:-1]:
        for part in set(found.values()):
            assert modularity_by_hand(links, found | {node: part}) <= best + 1e-9


def test_louvain_keeps_a_start(spark):
    """A start that no move improves is the result; nodes of other kinds than numbers do as well."""
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node string")
    start = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "c"), ("x", "y"), ("y", "y")], "node string, part string")
    assert {r["node"]: r["part"] for r in communities.louvain(nodes, links, start).collect()} == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1}


@pytest.mark.parametrize("whole_cells", [1_000_000, 70, 10])
def test_kumar_by_components(spark, whole_cells, monkeypatch):
    """All components in one task, each in its own, and the large ones by the table of pairs, which the others don't make."""
    monkeypatch.setattr(communities, "WHOLE_CELLS", whole_cells)
    groups = [set(range(first, first + 5)) for first in (0, 10, 100, 110)]
    edges = [x for g in groups for x in combinations(sorted(g), 3)] + [(0, 10), (100, 110), (200, 201), (300,)]
    if whole_cells > 10:
        monkeypatch.setattr(communities, "two_section", None)
    found = communities.dict2part({r["node"]: r["part"] for r in communities.kumar(build.from_dict(spark, dict(enumerate(edges)))).collect()})
    assert sorted(found, key=min) == [*groups, {200, 201}, {300}]


def test_two_section_in_a_task(monkeypatch):
    """All pairs held, or only those that occur, added up some at a time; edges of one node have none."""
    monkeypatch.setattr(communities, "PAIRS_AT_ONCE", 5)
    rng = random.Random(6)
    edges = [(rng.sample(range(12), rng.randint(1, 6)), rng.random()) for _ in range(40)]
    known = defaultdict(float)
    for members, w in edges:
        for a, b in combinations(members, 2):
            known[a, b] += w / (len(members) - 1)
            known[b, a] += w / (len(members) - 1)
    cells = [(i, node, w) for i, (members, w) in enumerate(edges) for node in members]
    rng.shuffle(cells)
    edge, node, w = (np.array(x) for x in zip(*cells, strict=True))
    for most in (144, 0):
        monkeypatch.setattr(communities, "DENSE_PAIRS", most)
        src, dst, weight = communities._section(edge, node, w, 12)
        assert list(zip(src, dst, strict=True)) == sorted(known) and weight == pytest.approx([known[x] for x in sorted(known)])


@pytest.mark.parametrize("most_words", [1, 3])
def test_reach(spark, most_words):
    """Components of many sizes, more sources than a batch has bits, vertices without links, loops and repeated links."""
    rng = random.Random(most_words)
    links = random_links(rng, 90, 0.03) + random_links(rng, 8, 0.4, 200) + [(i, i + 1) for i in range(300, 330)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    vertices = sorted(set(range(90)) | set(near) | {999})
    known = {}
    for v in vertices:
        seen, edge, step, out = {v}, {v}, 0, [0, 0, 0, 0.0]
        while edge := {y for x in edge for y in near[x]} - seen:
            seen, step = seen | edge, step + 1
            out = [out[0] + len(edge), out[1] + step * len(edge), step, out[3] + len(edge) / step]
        known[v] = out
    frame = spark.createDataFrame(links + [links[0], (0, 0)], "src long, dst long")
    found = distances.reach(spark.createDataFrame([(v,) for v in vertices], "id long"), frame, most_words).collect()
    assert len(found) == len(vertices)
    for r in found:
        assert [r["reached"], r["total"], r["far"]] == known[r["id"]][:3] and r["inverse"] == pytest.approx(known[r["id"]][3])


def test_dense_index(spark):
    rng = random.Random(2)
    ids = [rng.randint(-500, 500) for _ in range(700)]
    found = {r["x"]: r["idx"] for r in pairs.dense_index(spark.createDataFrame([(i,) for i in ids], "x long").repartition(5), "x").collect()}
    assert found == {x: i for i, x in enumerate(sorted(set(ids)))}
    assert pairs.dense_index(spark.createDataFrame([], "x long"), "x").count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST_HUB", 3)
    monkeypatch.setattr(components, "TASK_LINKS", 10)
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 220)] + [(201, 140)]
    found = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert found == {i: 0 for i in range(60)} | {i: 100 for i in [*range(100, 141), *range(200, 220)]}


def test_rules_that_are_callables(spark):
    """Beside names, with nulls left out, in an order, for incidences and for properties."""
    rows = [("e", "n", 1.0, "b", 2), ("e", "n", 4.0, "a", 1), ("e", "m", 2.0, None, 1), ("f", "n", None, "c", 1)]
    frame = spark.createDataFrame(rows, "edge string, node string, w double, x string, at int")
    got = properties.aggregated(frame, ["edge", "node"], {"w": lambda v: v.max() - v.min() if len(v) else None, "x": "max"}).collect()
    assert {(r["edge"], r["node"]): (r["w"], r["x"]) for r in got} == {("e", "n"): (3.0, "b"), ("e", "m"): (0.0, None), ("f", "n"): (None, "c")}
    got = properties.aggregated(frame, ["edge"], {"x": "-".join}, "at").collect()
    assert {r["edge"]: r["x"] for r in got}["f"] == "c" and {r["edge"]: r["x"] for r in got}["e"] == "a-b"
    graph = HGraph.from_dataframe(frame, "edge", "node", "w", aggregate_by=lambda v: v.prod())
    assert {(r["edge"], r["node"]): r["weight"] for r in graph.incidences.collect()}["e", "n"] == 4.0
    same = build.from_dict(spark, {"a": ["x", "y"], "b": ["x", "y"], "c": ["x"]}).collapse_edges(return_counts=False, aggregate_cells_by={"weight": lambda v: v.sum() * 10})
    assert {(r["edge"], r["node"]): r["weight"] for r in same.incidences.collect()} == {("a", "x"): 20.0, ("a", "y"): 20.0, ("c", "x"): 10.0}
