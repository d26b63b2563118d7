"""Components, distances, centralities, walks, communities, homology, matchings, epidemics and generators."""

import math
import random

import numpy as np
import pytest
from graphs import BIGFISH, COMPONENTS, CONNECTIVITY, DUPES, FISH, MODULAR, SCOMP, SEVEN, SIXBYFIVE, TRILOOP, TRILOOP2

from setgraph.errors import NonUniformError, SetGraphError, TooLargeError
from setgraph.functions import rules
from setgraph.operators import centrality, communities, connectivity, distances, epidemics, generators, homology, layout, matching, pairs, reports, walks
from setgraph.operators.components import connected_components
from setgraph.sources import collections as build


@pytest.fixture(scope="module")
def graph(spark):
    made = {}

    def get(given):
        key = str(given)
        if key not in made:
            made[key] = (build.from_dict if isinstance(given, dict) else build.from_lists)(spark, given).persist()
        return made[key]

    return get


def values(df, key="id", value="value", places=5):
    return {r[key]: round(r[value], places) for r in df.collect()}


def members(df):
    return {tuple(r["members"]) for r in df.collect()}


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(1, None)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: find(x) for a, b in links if b is not None and a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_connectivity(graph):
    g = graph(CONNECTIVITY)
    assert [g.is_connected(1), g.is_connected(2), g.is_connected(2, True), g.is_connected(3, True)] == [True, False, True, False]
    g = graph(SCOMP)
    assert [g.s_components(s).count() for s in (1, 2, 3)] == [1, 2, 4]
    assert [g.s_components(s, edges=False).count() for s in (3, 4)] == [7, 8]
    assert members(graph(COMPONENTS).connected_components()) == {(1, 2, 3, 4), (5, 6), (7,)}
    assert members(graph(SEVEN).s_components(2)) == {("I", "P", "S"), ("L",), ("O",), ("R",)}
    assert members(graph(DUPES).s_components(2, edges=False)) == {("A", "K", "T2"), ("C", "E", "F"), ("T1",), ("V",)}
    assert members(graph(DUPES).s_connected_components(2)) == {("I", "P", "S"), ("L", "M", "R")}
    parts = list(graph(COMPONENTS).component_subgraphs())
    assert [p.shape for p in parts] == [(4, 2), (2, 2)]
    assert len(list(graph(COMPONENTS).connected_component_subgraphs())) == 3


def test_written_component_subgraphs(spark, graph, tmp_path):
    """All subgraphs by one job, each opened on its own; properties come along."""
    g = graph(COMPONENTS).with_properties(edge_properties={"C": {"weight": 3.0}})
    folder = str(tmp_path / "parts")
    connectivity.write_component_subgraphs(g, folder)
    assert sorted(r[0] for r in spark.read.parquet(folder).select("component").distinct().collect()) == ["A", "C"]
    part = connectivity.component_subgraph(g, folder, "C")
    assert part.shape == (2, 2) and part.edges["C"].weight == 3.0 and "PushedFilters: [IsNotNull(component), EqualTo(component,C)]" in part.incidences._jdf.queryExecution().toString()
    assert connectivity.component_subgraph(g, folder, "E").shape == (0, 0)
    connectivity.write_component_subgraphs(g, folder, edges=False, return_singletons=True)
    assert [connectivity.component_subgraph(g, folder, c).shape for c in (1, 5, 7)] == [(4, 2), (2, 2), (1, 1)]


def test_distances(graph):
    g = graph(SEVEN)
    assert g.diameter() == 3 == g.edge_diameter()
    with pytest.raises(SetGraphError):
        g.diameter(2)
    assert g.distance("V", "E") == 2 and g.distance("V", "V") == 0 and math.isinf(g.distance("V", "none"))
    c = graph(CONNECTIVITY)
    assert c.edge_distance(0, 3) == 2 and math.isinf(c.edge_distance(0, 3, 3)) and c.edge_distance(0, 2, 2) == 2
    assert connectivity.node_diameters(graph(COMPONENTS))[0] == 2


def test_distances_and_betweenness_match_searches(graph):
    """All pairs and Brandes' sums against searches from each vertex."""
    for g, edges in ((graph(FISH), False), (graph(SIXBYFIVE), True), (graph(CONNECTIVITY), True)):
        vertices, links = pairs.get_linegraph(g, 1, edges)
        ids, near = sorted(r[0] for r in vertices.collect()), {}
        for r in links.collect():
            near.setdefault(r["src"], set()).add(r["dst"])
            near.setdefault(r["dst"], set()).add(r["src"])
        found, raw = {}, dict.fromkeys(ids, 0.0)
        for v in ids:
            ways, level, depth, counted = {v: 1}, {v: 0}, 0, [[v]]
            while counted[-1]:
                depth, step = depth + 1, {}
                for x in counted[-1]:
                    for y in near.get(x, ()):
                        if y not in level:
                            step[y] = step.get(y, 0) + ways[x]
                ways |= step
                level |= dict.fromkeys(step, depth)
                counted.append(list(step))
            found |= {(v, x): d for x, d in level.items() if d}
            share = dict.fromkeys(level, 0.0)
            for step in reversed(counted):
                for y in step:
                    for x in near.get(y, ()):
                        if level.get(x, -1) == level[y] - 1:
                            share[x] += ways[x] / ways[y] * (1 + share[y])
            for x in share:
                raw[x] += share[x] / 2 if x != v else 0
        assert {(r["src"], r["dst"]): r["distance"] for r in distances.all_pairs(vertices, links).collect()} == found
        assert {r["id"]: r["raw"] for r in distances.betweenness_sums(vertices, links).collect()} == pytest.approx(raw)


def test_centralities(graph):
    fish, six = graph(FISH), graph(SIXBYFIVE)
    got = values(centrality.s_betweenness_centrality(fish))
    assert got == {"AB": 0.2, "BC": 0.2, "ACD": 0.2, "AG": 0, "BEH": 0, "CF": 0}
    got = values(centrality.s_betweenness_centrality(fish, edges=False, normalized=False))
    assert (got["B"], got["A"], got["C"], got["H"]) == (10, 7.5, 7.5, 0)
    assert values(centrality.s_closeness_centrality(fish)) == {"AB": 0.83333, "BC": 0.83333, "ACD": 0.83333, "AG": 0.625, "BEH": 0.625, "CF": 0.625}
    assert values(centrality.s_harmonic_centrality(fish))["AB"] == 4.5 and values(centrality.s_harmonic_centrality(fish, source="CF")) == {"CF": 3.5}
    assert set(values(centrality.s_harmonic_closeness_centrality(six)).values()) == {0.66667}
    assert values(centrality.s_harmonic_closeness_centrality(six, 2)) == {"e0": 0.66667, "e4": 0.66667, "e1": 0.58333, "e2": 0.58333, "e3": 0.5}
    assert values(centrality.s_harmonic_closeness_centrality(six, 3)) == {"e0": 0.25, "e3": 0.25, "e4": 0.33333, "e1": 0, "e2": 0}
    assert set(values(centrality.s_eccentricity(six)).values()) == {1}
    assert values(centrality.s_eccentricity(six, 2)) == {"e0": 1, "e4": 1, "e1": 2, "e2": 2, "e3": 2}
    with pytest.raises(SetGraphError):
        centrality.s_eccentricity(six, 3)
    assert set(values(centrality.s_closeness_centrality(six, 3, return_singletons=False))) == {"e0", "e3", "e4"}


def test_toplexes_and_layers(graph):
    assert {r["edge"] for r in graph(DUPES).toplexes().collect()} == {"L", "O", "P", "R", "S"}
    assert graph(DUPES).toplex_graph().shape == (8, 5)
    assert {r["edge"] for r in graph(SIXBYFIVE).toplexes().collect()} == {"e1", "e2", "e4"}
    assert {r["edge"] for r in graph(TRILOOP2).toplexes().collect()} == {"AB", "ACD", "BC"}
    assert values(layout.set_layering(graph(SIXBYFIVE)), "edge", "level") == {"e0": 0, "e1": 0, "e2": 0, "e3": 0, "e4": 1}
    assert {r["rep"]: r["label"] for r in layout.create_labels(graph(DUPES)).collect()}["L"] == "L x 2"
    assert {r["rep"]: r["label"] for r in layout.create_labels(graph(DUPES), as_set=True, with_counts=False).collect()}["L"] == "{L, M}"


def test_prefix_filter_finds_the_same_pairs(spark, monkeypatch):
    rng = random.Random(4)
    g = build.from_lists(spark, [rng.sample(range(14), rng.randint(1, 8)) for _ in range(60)])
    for s in (2, 3, 5):
        found = []
        for first in (2, 100):
            monkeypatch.setattr(pairs, "PREFIX_FROM", first)
            found.append({tuple(r) for r in pairs.pair_counts(g, 0, s).select("src", "dst", "overlap").collect()})
        assert found[0] == found[1] and found[0]


def test_matrices(graph):
    dense = {(r["row"], r["col"]) for r in graph(SEVEN).adjacency_matrix(2).collect()}
    assert dense == {("A", "K"), ("K", "A"), ("K", "T2"), ("T2", "K")}
    assert {r["id"] for r in graph(SEVEN).auxiliary_matrix(2)[0].collect()} == {"A", "K", "T2"}
    cells, nodes, edges = graph(SEVEN).incidence_matrix()
    assert cells.count() == 15 and {r["node"]: r["idx"] for r in nodes.collect()}["V"] == 6 and edges.count() == 6
    wide = graph(SEVEN).incidence_dataframe()
    assert wide.count() == 7 and len(wide.columns) == 7
    vertices, links = graph(SEVEN).bipartite()
    assert vertices.count() == 13 and links.count() == 15


def test_reports(graph):
    g = graph(SEVEN)
    out = reports.dist_stats(g)
    assert out["nrows"] == 7 and out["ncells"] == 15 and out["edge_size_list"] == [4, 3, 2, 2, 2, 2] and out["num_s_comps"] == 1 and out["degree_hist"] == {1: 2, 2: 2, 3: 3}
    assert reports.info_dict(g, node="A") == {"membs": ["P", "R", "S"], "degree": 3, "neighbors": ["C", "E", "K", "T2", "V"]}
    assert reports.info_dict(g, edge="P") == {"size": 3, "elements": ["A", "C", "K"]} and "not in" in reports.info(g, node="x")
    assert reports.s_node_diameter_dist(g) == [3]
    assert {r["size"]: r["n"] for r in reports.comp_dist(graph(COMPONENTS), True).collect()} == {4: 1, 2: 1, 1: 1}


def test_walks(graph):
    fish = graph(FISH)
    p = {(r["src"], r["dst"]): r["p"] for r in walks.prob_trans(fish).collect()}
    assert p["A", "A"] == pytest.approx(4 / 9) and p["A", "C"] == pytest.approx(1 / 9)
    for v in "ABCDEFGH":
        assert sum(x for (a, _), x in p.items() if a == v) == pytest.approx(1)
    pi = values(walks.get_pi(walks.prob_trans(fish), most_rounds=60), value="pi", places=3)
    assert pi == values(walks.stationary(fish), value="pi", places=3) and pi["A"] == round(3 / 14, 3)
    lap = {(r["row"], r["col"]): r["value"] for r in walks.norm_lap(fish).collect()}
    q = np.array([[p.get((a, b), 0) for b in "ABCDEFGH"] for a in "ABCDEFGH"])
    root = np.sqrt([3, 3, 3, 1, 1, 1, 1, 1])
    half = root[:, None] * q / root[None, :]
    assert np.allclose(np.eye(8) - (half + half.T) / 2, [[lap.get((a, b), 0) for b in "ABCDEFGH"] for a in "ABCDEFGH"])
    clusters = walks.spec_clus(fish, 2)
    assert clusters.count() == 8 and clusters.select("cluster").distinct().count() == 2


def test_modularity(graph):
    g = graph(MODULAR)
    parts = [[set("ABC"), set("DEF")], [set("BC"), set("ADEF")], [set("ABCDEF")], [{x} for x in "ABCDEF"]]
    for rule, wanted in ((rules.linear, [0.414445, -0.037468, 0, -0.191730]), (rules.majority, [0.393798, -0.034351, 0, -0.220780]), (rules.strict, [0.434907, -0.023858, 0, -0.128876])):
        assert [communities.modularity(g, a, rule) for a in parts] == pytest.approx(wanted, abs=1e-6)
    cut = {"ABC": 1 / 2, "DEF": 4 / 7, "BC": 7 / 4, "ADEF": 7 / 11, "A": 11 / 4, "B": 5 / 2, "D": 3, "F": 8 / 3}
    for nodes, wanted in cut.items():
        assert communities.conductance(g, nodes) == pytest.approx(wanted)
    for nodes in ("ABCDEF", ""):
        with pytest.raises(SetGraphError):
            communities.conductance(g, nodes)
    even = g.with_properties(edge_properties=dict.fromkeys(range(6), 2.0))
    assert communities.modularity(even, parts[0]) == pytest.approx(0.414445, abs=1e-6)


def test_modularity_with_many_volumes(graph, monkeypatch):
    """Volumes or sizes go to every task, with the same result; a small grid is summed in steps; two large sides raise."""
    g = graph(MODULAR)
    parts = [[set("ABC"), set("DEF")], [set("ABCDEF")], [{x} for x in "ABCDEF"]]
    wanted = [communities.modularity(g, p, rule) for rule in (rules.linear, rules.strict) for p in parts]
    monkeypatch.setattr(communities, "MOST_VOLUMES", 0)
    monkeypatch.setattr(communities, "GRID", 2)
    assert [communities.modularity(g, p, rule) for rule in (rules.linear, rules.strict) for p in parts] == pytest.approx(wanted, abs=1e-9)
    monkeypatch.setattr(communities, "MOST_TERMS", 2)
    with pytest.raises(TooLargeError):
        communities.modularity(g, parts[0])


def test_communities(graph):
    g = graph(MODULAR)
    found = communities.dict2part({r["node"]: r["part"] for r in communities.kumar(g).collect()})
    assert sorted(map(sorted, found)) == [list("ABC"), list("DEF")]
    moved = communities.last_step(g, [set("AB"), set("C"), set("DEF")])
    assert communities.modularity(g, moved) > communities.modularity(g, [set("AB"), set("C"), set("DEF")])
    assert communities.part2dict([{"a"}, {"b", "c"}]) == {"a": 0, "b": 1, "c": 1}
    vertices, links = communities.two_section(g)
    assert vertices.count() == 6 and {(r["src"], r["dst"]): r["weight"] for r in links.collect()}["A", "B"] == pytest.approx(1.5)


def test_homology(graph):
    assert homology.betti_numbers(graph(FISH)) == {1: 1, 2: 0}
    assert homology.betti_numbers(graph(TRILOOP)) == {1: 1, 2: 0}
    assert homology.betti_numbers(graph(BIGFISH)) == {1: 1, 2: 1}
    assert homology.betti_numbers(graph(SEVEN), [1, 3]) == {1: 1, 2: 0, 3: 0}
    assert [homology.kchainbasis(graph(SEVEN), k).count() for k in range(4)] == [7, 11, 5, 1]
    basis = homology.hypergraph_homology_basis(graph(TRILOOP), 1, shortest=True)[1]
    assert [sorted(x) for x in basis] == [[("A", "B"), ("A", "C"), ("B", "C")]]
    raw = homology.hypergraph_homology_basis(graph(TRILOOP), 1, interpreted=False)[1]
    assert len(raw) == 1 and len(raw[0]) == 5
    with pytest.raises(SetGraphError):
        homology.chain_complex(graph(FISH), 0)


def test_matrices_mod_2():
    rng = np.random.default_rng(3)
    for _ in range(20):
        m = rng.integers(0, 2, (rng.integers(1, 7), rng.integers(1, 9)))
        left, s, inverse = homology.reduced_row_echelon_form_mod2(m)
        assert (homology.logical_matmul(left, m) == s).all() and (homology.logical_matmul(left, inverse) == np.eye(len(m))).all()
        left, right, s, inverse = homology.smith_normal_form_mod2(m)
        assert (homology.matmulreduce([left, m, right]) == s).all() and (homology.logical_matmul(left, inverse) == np.eye(len(m))).all()
        rank = int(s.sum())
        assert (s == np.eye(*m.shape) * (np.arange(m.shape[0]) < rank)[:, None]).all()
        assert rank == homology.rank_mod2(int("".join(map(str, row)), 2) for row in m)
    assert homology.logical_dot([1, 1], [1, 1]) == 0 and len(homology.boundary_group([[1, 0], [0, 1]])) == 4
    assert (homology.add_to_row(np.eye(2, dtype=int), 0, 1) == [[1, 1], [0, 1]]).all() and (homology.add_to_column(np.eye(2, dtype=int), 0, 1) == [[1, 0], [1, 1]]).all()
    assert (homology.bkMatrix([("A",), ("B",)], [("A", "B")]) == [[1], [1]]).all()
    assert homology.interpret([("A", "B"), ("B", "C")], [[0, 1]], {"B": 1, "C": 2}) == [[(1, 2)]]
    for wrong in (lambda: homology.logical_dot([1], [1, 0]), lambda: homology.logical_matadd(np.eye(2), np.eye(3)), lambda: homology.logical_matmul(np.eye(2), np.eye(3)), lambda: homology.interpret([("A",)], [[0, 1]])):
        with pytest.raises(SetGraphError):
            wrong()


def chain(spark, n):
    return build.from_dict(spark, {i: [i, i + 1, i + 2] for i in range(1, n + 1)})


def is_matching(graph, found):
    nodes = [r["node"] for r in graph.pairs.join(found, "edge", "left_semi").collect()]
    return len(nodes) == len(set(nodes))


def test_matching(spark, graph):
    g = chain(spark, 30)
    found = matching.maximal_matching(g)
    assert sorted(r["edge"] for r in found.collect()) == list(range(1, 31, 3))
    rng = random.Random(2)
    random_graph = build.from_dict(spark, {i: rng.sample(range(40), 3) for i in range(40)})
    used, taken = set(), []
    lists = {r["edge"]: r["nodes"] for r in random_graph.elements().collect()}
    for e in sorted(lists):
        if not used & set(lists[e]):
            used |= set(lists[e])
            taken.append(e)
    assert sorted(r["edge"] for r in matching.maximal_matching(random_graph).collect()) == taken
    for other in (matching.greedy_matching(random_graph, 3), matching.iterated_sampling(random_graph, 12, seed=1), matching.HEDCS_matching(random_graph, 10)):
        assert is_matching(random_graph, other) and other.count() >= len(taken) / 3
        left = random_graph.pairs.join(other, "edge", "left_semi")
        assert matching.approximation_matching_checking(random_graph.pairs, left) or other.count()
    sub = matching.build_HEDCS(random_graph, 9, 5)
    degree = {r["node"]: r["degree"] for r in sub.node_degrees().collect()}
    held = {r["edge"] for r in sub.pairs.collect()}
    for e, nodes in lists.items():
        total = sum(degree.get(n, 0) for n in nodes)
        assert total <= 9 if e in held else total >= 5
    with pytest.raises(NonUniformError):
        matching.greedy_matching(graph(SEVEN), 2)
    assert matching.check_beta_condition(9, 5, 3) and not matching.check_beta_condition(5, 5, 3)


def test_contagion_rules(spark):
    g = build.from_dict(spark, {"a": [0, 1, 2], "b": [0, 1, 2, 3], "c": [3], "d": [0, 3]})
    status = spark.createDataFrame([(0, "S"), (1, "I"), (2, "I"), (3, "S")], "node long, status string")
    got = {rule.__name__: {(r["edge"], r["node"]) for r in epidemics.transmission(g, status, rule).filter("force > 0").collect()} for rule in (rules.collective_contagion, rules.individual_contagion, rules.threshold, rules.majority_vote)}
    assert got["individual_contagion"] == {("a", 0), ("b", 0), ("b", 3)} == got["threshold"] == got["majority_vote"]
    assert got["collective_contagion"] == {("a", 0), ("c", 3)}
    assert epidemics.transmission(g, status, rules.threshold, tau=0.9).filter("force > 0").count() == 1


def test_epidemics(spark):
    rng = random.Random(1)
    g = build.from_lists(spark, [rng.sample(range(60), rng.choice([2, 3])) for _ in range(200)]).persist()
    n, tau = g.order(), {2: 0.3, 3: 0.3}
    trace = epidemics.discrete_SIR(g, tau, 0.3, rho=0.1, tmax=3, dt=1.0, seed=4).orderBy("t").collect()
    assert all(r["S"] + r["I"] + r["R"] == n for r in trace) and trace[1]["t"] - trace[0]["t"] == 1.0
    again = epidemics.discrete_SIR(g, tau, 0.3, rho=0.1, tmax=3, dt=1.0, seed=4).orderBy("t").collect()
    assert trace == again
    sis = epidemics.discrete_SIS(g, tau, 0.3, initial_infecteds=[0, 1, 999], tmax=2, seed=4).orderBy("t").collect()
    assert sis[0]["I"] == 2 and all(r["S"] + r["I"] == n for r in sis)
    events = epidemics.discrete_SIR(g, tau, 0.3, initial_infecteds=[0], initial_recovereds=[1], tmax=2, return_full_data=True, seed=4)
    assert {r["status"] for r in events.filter("t = 0").collect()} == {"I", "R"}
    for run in (epidemics.Gillespie_SIR, epidemics.Gillespie_SIS):
        found = run(g, tau, 0.5, rho=0.1, tmax=0.6, dt=0.2, seed=3)
        rows = found.orderBy("t").collect()
        assert [round(r["t"], 6) for r in rows] == [0, 0.2, 0.4, 0.6] and all(r["S"] + r["I"] + (r["R"] if "R" in found.columns else 0) == n for r in rows)
    with pytest.raises(SetGraphError):
        epidemics.discrete_SIR(g, tau, 0.3, initial_infecteds=[1], rho=0.5)


def test_generators(spark):
    g = generators.erdos_renyi_hypergraph(spark, 1000, 1000, 0.01, seed=42)
    assert abs(g.incidences.count() - 10_000) < 400 and g.pairs.distinct().count() == g.incidences.count()
    assert generators.erdos_renyi_hypergraph(spark, 5, 4, 1.0).incidences.count() == 20
    assert generators.erdos_renyi_hypergraph(spark, 5, 4, 0.0).incidences.count() == 0
    labelled = generators.erdos_renyi_hypergraph(spark, 2, 2, 1.0, ["a", "b"], ["x", "y"])
    assert set(labelled.nodes) == {"a", "b"}
    rng = random.Random(1)
    k1 = {i: rng.randint(1, 30) for i in range(400)}
    k2 = dict(enumerate(sorted(k1.values())))
    g = generators.chung_lu_hypergraph(spark, k1, k2, seed=1)
    assert abs(g.incidences.count() / sum(k1.values()) - 1) < 0.05
    g1, g2 = ({i: i % 2 for i in k} for k in (k1, k2))
    half = sum(k1.values()) / 2
    g = generators.dcsbm_hypergraph(spark, k1, k2, g1, g2, [[half, 0], [0, half]], seed=1)
    assert g.pairs.filter("(edge + node) % 2 = 1").count() == 0 and g.incidences.count() > half
    with pytest.warns(UserWarning):
        generators.chung_lu_hypergraph(spark, {1: 5}, {1: 1})


def test_streaming(spark, tmp_path):
    from setgraph import streaming

    rows = [("e1", "a", "2024-01-01 00:01:00"), ("e1", "b", "2024-01-01 00:02:00"), ("e1", "b", "2024-01-01 00:03:00"), ("e2", "a", "2024-01-01 02:00:00"), ("e3", "a", "2024-01-01 09:00:00")]
    df = spark.createDataFrame(rows, "edge string, node string, ts string").selectExpr("edge", "node", "to_timestamp(ts) AS ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streaming.windowed_sizes(stream, "ts").writeStream.format("memory").queryName("sizes").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {(r["edge"], r["size"]) for r in spark.table("sizes").collect()}
    assert ("e1", 2) in got and ("e3", 1) not in got
    out = streaming.running_sizes(stream).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert {(r["edge"], r["size"]) for r in spark.table("running").collect()} == {("e1", 2), ("e2", 1), ("e3", 1)}
