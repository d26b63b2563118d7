"""Steps that larger tables need: each test fails with the step that was there before."""

import itertools
import os
import random

import pytest

from setgraph.graph import HGraph
from setgraph.operators import centrality, communities, components, connectivity, distances, epidemics, generators, homology, matching, pairs, walks
from setgraph.plans import lineage
from setgraph.sources import collections as build


def random_graph(spark, rng, n_edges, n_nodes, most=4, offset=0):
    return build.from_dict(spark, {offset + i: rng.sample(range(n_nodes), rng.randint(1, most)) for i in range(n_edges)})


def rows(df):
    return sorted(map(tuple, df.collect()))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_random_graphs_send_no_incidences_to_every_task(spark):
    """What blocks draw is not as few as the blocks are (F1, F2)."""
    k = {i: 3 + i % 2 for i in range(300)}
    groups = {i: i % 2 for i in k}
    half = sum(k.values()) / 2
    for graph in (generators.chung_lu_hypergraph(spark, k, k, seed=1), generators.dcsbm_hypergraph(spark, k, k, groups, groups, [[half, 0], [0, half]], seed=1)):
        drawn = graph.pairs
        assert len(drawn.collect()) > half
        assert "SortMergeJoin" in executed(drawn) and "BroadcastHashJoin [node_at" not in executed(drawn) and "BroadcastHashJoin [edge_at" not in executed(drawn)


def test_distance_without_a_line_graph(spark, monkeypatch):
    """For s = 1 a distance is searched over the incidences."""
    rng = random.Random(5)
    graph = random_graph(spark, rng, 30, 25, 3)
    lists = {r["edge"]: set(r["nodes"]) for r in graph.elements().collect()}
    at, frontier, step = {0: 0}, {0}, 0
    while frontier:
        step += 1
        frontier = {e for e in lists if e not in at and any(lists[e] & lists[f] for f in frontier)}
        at |= dict.fromkeys(frontier, step)

    def refuse(*_):
        raise AssertionError("a line graph")

    monkeypatch.setattr(connectivity, "pair_counts", refuse)
    for target in (0, max(at, key=at.get), next((e for e in lists if e not in at), -1)):
        assert connectivity.edge_distance(graph, 0, target) == at.get(target, float("inf"))
    assert rows(distances.incident_source(graph.pairs, "edge", "node", 0)) == sorted(at.items())


@pytest.mark.parametrize("task_pairs", [10, 1_000_000])
def test_pairs_by_common_pairs_and_dealt_hubs(spark, monkeypatch, task_pairs):
    """Both ways of counting agree with brute force; tasks grow with the pairs."""
    monkeypatch.setattr(pairs, "TASK_PAIRS", task_pairs)
    rng = random.Random(3)
    small_sets, large_sets = random_graph(spark, rng, 80, 12, 5), random_graph(spark, rng, 12, 80, 50)
    for graph in (small_sets, large_sets):
        for level, lists in ((0, graph.elements()), (1, graph.memberships())):
            held = {r[0]: set(r[1]) for r in lists.collect()}
            for s in (1, 2, 3):
                known = [(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= s]
                assert rows(pairs.pair_counts(graph, level, s).select("src", "dst", "overlap")) == sorted(known)
    made = pairs.pair_counts(small_sets, 0, 3)
    assert task_pairs > 10 or made.rdd.getNumPartitions() > 50


def test_links_are_read_once(spark, monkeypatch):
    """Diameters and centralities make the pairs once, and levels begin with vertices that have links."""
    graph = build.from_dict(spark, {1: "AB", 2: "ABC", 3: "BCD", 4: "CD", 5: "E", 6: "FG", 7: "FG"})
    calls, real = [], pairs.pair_counts
    for module in (pairs, connectivity):
        monkeypatch.setattr(module, "pair_counts", lambda *args: calls.append(1) or real(*args))
    assert rows(connectivity.component_diameters(graph, 2, edges=True).select("component", "diameter")) == [(1, 3), (5, 0), (6, 1)]
    assert len(calls) == 1
    links = pairs.get_linegraph(graph, 2)
    assert distances._levels(*links, 10)[0].count() == 6
    assert {r["id"] for r in centrality.s_betweenness_centrality(graph, 2).collect()} == set(range(1, 8))


def test_components_link_only_the_lesser_side(spark, monkeypatch):
    """Components of edges and nodes come from links among the ids of the side with fewer."""
    graph = build.from_dict(spark, {i: [i % 3, 10 + i % 3] for i in range(30)} | {90: [50], 91: [60, 61]})
    real, links = connectivity.stars.connected_components, []
    monkeypatch.setattr(connectivity.stars, "connected_components", lambda given: links.append(given.distinct().count()) or real(given))
    labels = {r["id"]: r["component"] for r in connectivity.component_labels(graph, 1, edges=False).collect()}
    assert labels == {0: 0, 1: 1, 2: 2, 10: 0, 11: 1, 12: 2, 50: 50, 60: 60, 61: 60} and links == [4]
    assert {r["id"]: r["component"] for r in connectivity.component_labels(graph, 1).collect()} == {i: i % 3 for i in range(30)} | {90: 90, 91: 91}


def test_many_samples_are_not_many_rounds(spark):
    """Samples grow in number with the graph, and all are matched."""
    graph = build.from_dict(spark, {i: [2 * i, 2 * i + 1, 2 * i + 2] for i in range(300)})
    found = {r["edge"] for r in matching.iterated_sampling(graph, 20, seed=1).collect()}
    assert all(i + 1 not in found for i in found) and all({i - 1, i, i + 1} & found for i in range(300))


def test_spectral_clusters_without_a_laplacian(spark, monkeypatch):
    """The Laplacian isn't made; its product is the same."""
    graph = build.from_dict(spark, {0: "ABC", 1: "BC", 2: "CD", 3: "DEF", 4: "EF"})
    vectors = graph.pairs.selectExpr("node AS id").distinct().selectExpr("id", "array(ascii(id) * 1.0D, cos(ascii(id))) AS v")
    table, through = (a(vectors, 2) for a in (walks._by_table(walks.norm_lap(graph)), walks._through_incidences(graph)[1]))
    near = {r["row"]: (r["s0"], r["s1"]) for r in through.collect()}
    assert all(near.pop(r["row"]) == pytest.approx((r["s0"], r["s1"])) for r in table.collect()) and not near
    monkeypatch.setattr(walks, "norm_lap", None)
    part = {r["node"]: r["cluster"] for r in walks.spec_clus(graph, 2, rounds=5).collect()}
    assert part["A"] == part["B"] and part["E"] == part["F"] != part["A"]


def test_last_step_works_out_each_volume_once(spark, monkeypatch):
    """Sizes of edges have no bound where volumes are few, and both ways agree (F16)."""
    rng = random.Random(4)
    graph = random_graph(spark, rng, 12, 20, 9)
    parts = {n: n % 3 for n in range(20)}
    monkeypatch.setattr(communities, "MOST_TERMS", 1)
    few = rows(communities.last_step(graph, parts))
    monkeypatch.setattr(communities, "MOST_TERMS", 1000)
    monkeypatch.setattr(communities, "MOST_VOLUMES", 0)
    assert few == rows(communities.last_step(graph, parts))


def test_epidemics_read_the_incidences_once(spark):
    """Steps read written incidences, not what they were made from."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    graph = HGraph.of(spark.createDataFrame([(i // 3, i % 7) for i in range(30)], "edge long, node long").mapInPandas(count, "edge long, node long"))
    for run in (epidemics.discrete_SIS, epidemics.Gillespie_SIS, epidemics.discrete_SIR, epidemics.Gillespie_SIR):
        before = read.value
        run(graph, {3: 0.2}, 0.1, rho=0.3, tmax=3, dt=1.0, seed=1).collect()
        assert read.value - before == 30


@pytest.mark.parametrize(("few", "marks"), [(0, 1000), (5, 8)])
def test_eccentricities_without_a_line_graph(spark, monkeypatch, few, marks):
    """For s = 1 they come from the incidences, by tests or searches or both."""
    rng = random.Random(few + marks)
    near = {i: [0, *rng.sample(range(1, 90), 3)] if i < 3 else rng.sample(range(90), 4) for i in range(200)}
    whole = {0: list(range(70))}
    monkeypatch.setattr(distances, "FIRST_MARKS", marks)
    monkeypatch.setattr(distances, "FEW", max(few, 1))
    for module in (connectivity, centrality):
        monkeypatch.setattr(module, "get_linegraph", None)
    for table in (near, whole):
        graph = build.from_dict(spark, table)
        sets = {}
        for edge in table.values():
            for a in edge:
                sets.setdefault(a, set()).update(edge)
        far = {}
        for a in sets:
            seen, front, far[a] = {a}, {a}, -1
            while front:
                far[a] += 1
                front = {c for b in front for c in sets[b]} - seen
                seen |= front
        assert {r["id"]: r["value"] for r in centrality.s_eccentricity(graph, 1, edges=False).collect()} == far
    assert connectivity.diameter(graph) == 1


def test_faces_meet_their_cells_by_columns(spark):
    """Boundaries join nodes, not arrays of them, and are the same (F20, and F8 and F15, which begin with one)."""
    graph = random_graph(spark, random.Random(6), 40, 9, 5)
    held = [sorted(r["nodes"]) for r in graph.elements().collect()]
    for k in (1, 2, 3):
        names = [sorted({c for h in held for c in itertools.combinations(h, j + 1)}) for j in (k - 1, k)]
        cells = [homology.indexed_cells(graph, j) for j in (k - 1, k)]
        assert [rows(c.select("idx", "cell")) for c in cells] == [[(i, list(c)) for i, c in enumerate(n)] for n in names]
        known = sorted((names[0].index(f), j) for j, c in enumerate(names[1]) for f in itertools.combinations(c, k))
        found = homology.boundary(*cells)
        assert rows(found) == known == rows(homology.boundary(*cells, k))
        assert "[cell" not in executed(found)
    empty = homology.indexed_cells(graph, 7)
    assert homology.boundary(empty, empty).count() == 0


def _ones(rng, n_rows, n_cols, n):
    return [(rng.randrange(n_rows), rng.randrange(n_cols)) for _ in range(n)]


@pytest.mark.parametrize("task_cells", [20, 1_000_000])
def test_products_mod_2_send_lists(spark, monkeypatch, task_cells):
    """Tasks grow with the products, hubs are dealt, and repeated 1s count as often as they come (F8)."""
    monkeypatch.setattr(homology, "TASK_CELLS", task_cells, raising=False)
    rng = random.Random(7)
    a, b = [*_ones(rng, 30, 12, 90), *((3, k) for k in range(12))], [*_ones(rng, 12, 40, 120), *((5, j) for j in range(40))]
    known = {}
    for i, k in a:
        for _, j in (x for x in b if x[0] == k):
            known[i, j] = known.get((i, j), 0) + 1
    tables = [spark.createDataFrame(x, "row long, col long") for x in (a, b)]
    found = homology.logical_matmul_table(*tables)
    assert rows(found) == sorted(at for at, n in known.items() if n % 2) and found.columns == ["row", "col"]
    assert task_cells > 20 or found.rdd.getNumPartitions() > 20
    assert homology.logical_matmul_table(tables[0].limit(0), tables[1]).count() == 0


@pytest.mark.parametrize("task_cells", [20, 1_000_000])
def test_sums_mod_2_are_counted_by_more_tasks(spark, monkeypatch, task_cells):
    """Tasks grow with the 1s of both matrices."""
    monkeypatch.setattr(homology, "TASK_CELLS", task_cells, raising=False)
    rng = random.Random(8)
    a, b = _ones(rng, 20, 20, 250), _ones(rng, 20, 20, 250)
    found = homology.logical_matadd_table(*(spark.createDataFrame(x, "row long, col long") for x in (a, b)))
    assert rows(found) == sorted(x for x in {*a, *b} if (a.count(x) + b.count(x)) % 2)
    assert task_cells > 20 or found.rdd.getNumPartitions() > 20


def test_line_graphs_read_incidences_once_in_enough_tasks(spark, monkeypatch):
    """Ids and links come from one reading, and tasks grow with the rows."""
    from setgraph.plans import tasks

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    given = [(e, n) for e in range(6) for n in (e, e + 1, e // 3 + 50, e // 3 + 60)]
    graph = HGraph.of(spark.createDataFrame(given, "edge long, node long").mapInPandas(count, "edge long, node long"))
    assert rows(connectivity.component_labels(graph, 2)) == [(e, e // 3 * 3) for e in range(6)]
    assert read.value == len(given)
    monkeypatch.setattr(tasks, "TASK_ROWS", 5)
    df = spark.range(24).withColumnRenamed("id", "edge")
    assert tasks.spread(df, 24, "edge").rdd.getNumPartitions() == 5 and tasks.spread(df, 10, "edge") is df


def test_degree_constrained_subgraphs_read_incidences_once(spark):
    """Rounds read written incidences."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    given = [(e, n) for e in range(8) for n in (0, 1 + e % 3, 10 + e)]
    graph = HGraph.of(spark.createDataFrame(given, "edge long, node long").mapInPandas(count, "edge long, node long"))
    assert matching.HEDCS_matching(graph, 8, beta=9, beta_minus=5).count() == 1  # all edges share a node
    assert read.value == len(given)


def test_tasks_grow_with_the_incidences_drawn(spark, monkeypatch):
    """The same incidences, by more tasks if many are expected, and by no more tasks than blocks."""
    few = generators.erdos_renyi_hypergraph(spark, 20_000, 50, 0.01, seed=3).pairs
    monkeypatch.setattr(generators, "TASK_DRAWN", 700)
    many = generators.erdos_renyi_hypergraph(spark, 20_000, 50, 0.01, seed=3).pairs
    assert few.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism == 8 and many.rdd.getNumPartitions() == 15
    assert sorted(few.collect()) == sorted(many.collect())
    assert generators.erdos_renyi_hypergraph(spark, 3_000, 500, 0.01, seed=3).pairs.rdd.getNumPartitions() == 3


def test_estimates_of_size_stay_small_in_iterations(spark):
    """Rounds don't multiply the estimates of the rounds before (F2), and tables that are used are removed."""
    graph = build.from_dict(spark, {0: "ABC", 1: "BC", 2: "CD", 3: "DEF", 4: "EF"})
    ids, apply = walks._through_incidences(graph)
    found = walks._orthogonal_iteration(apply, ids, 2, 0, 6)
    links = spark.range(40).selectExpr("id AS src", "id + 1 AS dst")
    for df in (found, components.connected_components(links)):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 60
    first = lineage.written(ids)
    folder = lineage._folders[first]
    second = lineage.written(first.filter("id < 'C'"), first)
    assert rows(second) == [("A",), ("B",)] and not os.path.exists(folder)


@pytest.mark.parametrize("pass_cells", [60, 100_000_000])
def test_boundaries_without_joins_of_faces(spark, monkeypatch, pass_cells):
    """Faces have their places by arithmetic, cells are sorted in passes, and what was written on the way is removed."""
    monkeypatch.setattr(homology, "PASS_CELLS", pass_cells)
    monkeypatch.setattr(homology, "CHUNK_CELLS", pass_cells)
    graph = random_graph(spark, random.Random(9), 25, 9, 6)
    for k in (1, 2, 3):
        known = homology.boundary(*(homology.indexed_cells(graph, j) for j in (k - 1, k)))
        before = len(lineage._folders)
        found = homology.boundary_matrix(graph, k)
        assert "Join" not in executed(found).replace("BroadcastHashJoin [part", "") and rows(found) == rows(known)
        assert pass_cells < 100 or len(lineage._folders) - before <= 1
    named = build.from_dict(spark, {0: "ACB", 1: "DBC", 2: "A"})
    assert rows(homology.boundary_matrix(named, 2)) == [(0, 0), (1, 0), (2, 0), (2, 1), (3, 1), (4, 1)]
    assert homology.boundary_matrix(named, 4).count() == 0


def test_prefixes_only_where_they_drop_much(spark):
    """Where candidates would each be verified with long sets, pairs are counted, without lists (F6); both ways agree."""
    rng = random.Random(11)
    for graph, counted in ((random_graph(spark, rng, 60, 12, 5), True), (build.from_dict(spark, {i: [i, i + 1, i + 2, i + 3, *range(100, 106)] for i in range(0, 40, 8)} | {90 + i: [100, 102] for i in range(60)}), None)):
        for level, lists in ((0, graph.elements()), (1, graph.memberships())):
            held = {r[0]: set(r[1]) for r in lists.collect()}
            known = sorted((a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= 4)
            found = pairs.pair_counts(graph, level, 4)
            assert rows(found) == known
            assert not counted or "array_intersect" not in found._jdf.queryExecution().toString()


def test_estimates_stay_small_in_moves(spark, monkeypatch):
    """Moves of communities don't multiply estimates from round to round (F1)."""
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    monkeypatch.setattr(communities, "BLOCK_LINKS", 6)
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)] + [(i, i + 2, 0.5) for i in range(11)], "src long, dst long, weight double")
    nodes, seen, real = spark.range(13).withColumnRenamed("id", "node"), [], communities._with_volumes
    monkeypatch.setattr(communities, "_with_volumes", lambda parts: seen.append(real(parts)) or seen[-1])
    communities._communities(nodes, links).collect()
    assert len(seen) > 1 and max(map(bits, seen)) < 60
