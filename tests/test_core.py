"""Construction, views, properties, transforms and set operations on small graphs with known results."""

import json

import numpy as np
import pytest
from graphs import CONNECTIVITY, DUPES, SEVEN, SINGLES, TRILOOP2

from setgraph.errors import SetGraphError, TooLargeError
from setgraph.functions import properties as props
from setgraph.graph import HGraph
from setgraph.operators import pairs, reports, transforms
from setgraph.sources import collections as build
from setgraph.sources import interchange, texts


@pytest.fixture(scope="module")
def seven(spark):
    return build.from_dict(spark, SEVEN, name="seven").persist()


@pytest.fixture(scope="module")
def dupes(spark):
    return build.from_dict(spark, DUPES).persist()


def col(df, name=None):
    return sorted(r[name or 0] for r in df.collect())


def test_shapes(spark, seven, dupes):
    assert seven.shape == (7, 6) and dupes.shape == (8, 7)
    assert seven.incidences.count() == 15 and len(seven) == 7 and "A" in seven and "Z" not in seven
    assert build.from_dict(spark, TRILOOP2).incidences.count() == 12
    assert seven.edge_size_dist() == [2, 2, 2, 3, 2, 4]
    assert seven.dim("S") == 3 and seven.order() == 7


def test_degree_and_size(seven):
    assert [seven.degree("A", s) for s in (1, 2, 3)] == [3, 3, 2]
    assert seven.degree("A", 1, 2) == 1
    assert [seven.size("S", x) for x in (["T2", "V"], ["T1", "T2"], ["T2"], ["T1"], [])] == [2, 1, 1, 0, 0]
    assert {r["node"]: r["degree"] for r in seven.node_degrees(3).collect()}["E"] == 0


def test_neighbours(seven):
    assert seven.neighbors("A") == ["C", "E", "K", "T2", "V"] == sorted(seven["A"])
    assert seven.neighbors("T2", 2) == ["K"]
    assert seven.edge_neighbors("P") == ["I", "L", "R", "S"]
    assert seven.edge_neighbors("O", 2) == [] and seven.edge_neighbors("I", 2) == ["S"]
    assert seven.neighbors("nobody") == []


def test_dual_and_equality(seven, dupes):
    assert seven.dual().dual() == seven and seven.dual().shape == (6, 7)
    assert seven != dupes and seven.clone() == seven and seven.clone().name == "seven"


def test_classes(dupes):
    edges = {tuple(r["members"]) for r in dupes.equivalence_classes().collect()}
    assert edges == {("I",), ("L", "M"), ("O",), ("P",), ("R",), ("S",)}
    nodes = {tuple(r["members"]) for r in dupes.equivalence_classes(edges=False).collect()}
    assert nodes == {("A",), ("C",), ("E", "F"), ("K",), ("T1",), ("T2",), ("V",)}


def test_collapse(dupes):
    out, classes = dupes.collapse_edges(use_counts=True, return_equivalence_classes=True)
    assert col(out.pairs.select("edge").distinct()) == ["I:1", "L:2", "O:1", "P:1", "R:1", "S:1"]
    assert {r["rep"]: r["members"] for r in classes.collect()}["L:2"] == ["L", "M"]
    assert out.get_cell_properties("L:2", "C", "weight") == 2.0
    assert out.get_properties("L:2", 0, "equivalence_class_size") == 2
    assert dupes.collapse_edges(use_uids=["M"]).size("M") == 3
    assert dupes.collapse_nodes().shape == (7, 7)
    assert dupes.collapse_nodes_and_edges().shape == (7, 6)


def test_restrict_and_remove(seven):
    assert seven.restrict_to_edges(["P", "R"]).shape == (4, 2)
    assert seven.restrict_to_nodes(["K", "T2"]).shape == (2, 4)
    assert seven.remove_edges(["S"]).shape == (6, 5)
    assert seven.remove_nodes(["A"]).shape == (6, 6)
    assert seven.remove_incidences([("S", "V"), "O"]).shape == (5, 5)


def test_singletons(spark):
    graph = build.from_dict(spark, SINGLES)
    assert col(graph.singletons()) == [10, 12]
    assert graph.remove_singletons().shape == (7, 3)


def test_set_operations(seven, dupes):
    assert (seven + dupes).shape == (8, 7)
    only_i = seven - seven.remove_edges(["I"])
    assert only_i.shape == (2, 1)
    assert seven.intersection(seven.restrict_to_edges(["P"])).shape == (3, 1)
    assert (seven - dupes) + seven.intersection(dupes) == seven


def test_rename(spark, seven):
    out = seven.rename(edges={"P": "Q"}, nodes={"A": "C"})
    assert out.size("Q") == 2 and "A" not in out and out.shape == (6, 6)


def test_views(seven):
    assert sorted(seven.edges) == sorted(SEVEN) and len(seven.nodes) == 7 and ("P", "A") in seven.cells
    assert seven.edges["P"] == ["A", "C", "K"] and seven.nodes["A"].memberships == ["P", "R", "S"] and seven.edges["none"] is None
    assert seven.edges["P"].weight == 1.0 and seven.edges.default_weight == 1.0
    assert seven.edges.dataframe().count() == 6 and not seven.edges.is_empty()


def test_properties(spark, seven):
    table = spark.createDataFrame([("I", 43.0, '{"color": "red", "deep": {"x": 1}}'), ("Z", None, "{'a': 2}")], "id string, weight double, extra string")
    graph = seven.with_properties(edge_properties=table, misc_edge_properties_col="extra", node_properties={"A": {"weight": 2.0, "age": 7}})
    assert graph.get_properties("I")["x"] == 1 and graph.get_properties("I", 0, "color") == "red"
    assert graph.get_properties("Z", 0, "a") == 2 and graph.get_properties("none") == {"weight": 1.0}
    assert "Z" not in graph.edges and graph.edges.user_defined_properties().count() == 2
    assert graph.nodes["A"].age == 7 and graph.nodes["A"].weight == 2.0
    changed = graph.edge_properties.set_property("I", "color", "blue").set_property("P", "weight", 5)
    assert changed.get_property("I", "color") == "blue" and changed["P"]["weight"] == 5.0 and "P" in changed and changed.get_property("P", "none") is None
    coloured = graph.edge_properties.set_defaults({"color": "grey"})
    assert coloured.get_property("I", "color") == "red" and coloured.get_property("Z", "color") == "grey" and coloured["none"]["color"] == "grey"
    assert graph.dual().get_properties("I", 1, "color") == "red"


def test_additions(seven):
    graph = seven.add_edge("X", weight=3.0).add_node("N", kind="new").add_incidence("X", "N", weight=0.5, note="n").add_nodes_to_edges({"P": ["V"], "X": {"A": {"weight": 9.0}}})
    assert graph.shape == (8, 7) and graph.get_cell_properties("X", "N", "note") == "n" and graph.get_cell_properties("X", "A", "weight") == 9.0
    assert graph.get_properties("X", 0, "weight") == 3.0 and graph.size("P") == 4
    assert seven.add_edge("Y").shape == seven.shape
    assert graph.add_incidence("X", "N", weight=4.0).incidences.count() == graph.incidences.count()


def test_constructors(spark):
    assert build.from_lists(spark, CONNECTIVITY).shape == (8, 4)
    assert build.from_pairs(spark, np.array([[1, 2], [1, 2], [3, 4]])).incidences.count() == 2
    with pytest.raises(SetGraphError):
        build.from_pairs(spark, np.zeros((2, 3)))
    graph = build.from_numpy_array(spark, np.array([[1, 0, 2], [0, 0, 0]]))
    assert graph.shape == (1, 2) and graph.get_cell_properties("e2", "v0", "weight") == 2.0
    assert build.from_numpy_array(spark, np.array([[1, 0, 5]]), key=lambda v: v > 1).shape == (1, 1)
    wide = spark.createDataFrame([("A", 5, None, -2), ("B", 3, 2, 0), ("C", 1, 3, -1)], "node string, a int, b int, c int")
    assert build.from_incidence_dataframe(wide).incidences.count() == 7
    assert build.from_incidence_matrix(spark, np.eye(3)).shape == (3, 3)
    mixed = build.from_dict(spark, {"a": ["x"], "b": {"y": {"weight": 2, "t": [1, 2]}, "x": 3}})
    assert mixed.get_cell_properties("b", "y", "t") == [1, 2] and mixed.get_cell_properties("b", "x", "weight") == 3.0
    rows = spark.createDataFrame([("e", "n", 1.0, 2), ("e", "n", 5.0, 1), (None, "n", 1.0, 0)], "e string, n string, weight double, o int")
    assert HGraph.from_dataframe(rows, order_col="o").incidences.first()["weight"] == 5.0
    assert HGraph.from_dataframe(rows.drop("o"), aggregate_by="sum").incidences.first()["weight"] == 6.0
    empty = HGraph.from_dataframe(rows.filter("false"))
    assert empty.shape == (0, 0) and not empty.is_connected() and len(empty) == 0
    vertices = spark.createDataFrame([("a", 0), ("x", 1), ("y", 1)], "id string, bipartite int")
    assert build.from_bipartite(vertices, spark.createDataFrame([("a", "x"), ("y", "a")], "src string, dst string")).shape == (2, 1)
    with pytest.raises(SetGraphError):
        build.from_bipartite(vertices, spark.createDataFrame([("y", "x")], "src string, dst string"))
    arrays = spark.createDataFrame([("p", ["u", "v"]), ("q", ["v"])], "id string, members array<string>")
    assert build.from_array_column(arrays, "members", "id").shape == (2, 2)


class Coordinates:
    def __init__(self, row, col, data, shape):
        self.row, self.col, self.data, self.shape = row, col, data, shape

    def tocoo(self):
        return self


def test_sparse_matrices(spark):
    sparse = Coordinates([0, 0, 2, 2], [0, 2, 1, 1], [1.0, 2.0, 3.0, 4.0], (3, 3))  # one cell is stored in two pieces
    dense = np.array([[1.0, 0, 2], [0, 0, 0], [0, 7, 0]])
    for made in (build.from_numpy_array, build.from_incidence_matrix):
        rows = [sorted(tuple(r)[:3] for r in made(spark, m).incidences.select("edge", "node", "weight").collect()) for m in (sparse, dense)]
        assert rows[0] == rows[1] and len(rows[0]) == 3
    named = build.from_numpy_array(spark, sparse, node_names=["a", "b", "c"], edge_names=[10, 20, 30])
    assert {tuple(r) for r in named.pairs.collect()} == {(10, "a"), (30, "a"), (20, "c")} and named.get_cell_properties(20, "c", "weight") == 7.0
    with pytest.raises(SetGraphError):
        build.from_numpy_array(spark, sparse, node_names=["a"])
    assert build.from_numpy_array(spark, dense, key=lambda v: v >= 0).incidences.count() == 9
    assert build.from_numpy_array(spark, sparse, key=lambda v: v >= 2).incidences.count() == 2
    assert build.from_incidence_matrix(spark, np.zeros((2, 2))).shape == (0, 0)


def test_bounded_lists(seven, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_NEIGHBORS", 3)
    with pytest.raises(TooLargeError):
        seven.neighbors("A")
    assert seven.neighbors("T2", 2) == ["K"]
    assert {(r["node"], r["overlap"]) for r in pairs.neighbor_table(seven, "A").collect()} == {("C", 1), ("E", 1), ("K", 2), ("T2", 1), ("V", 1)}
    assert reports.dist_stats(seven, lists=False)["num_s_comps"] == 1
    monkeypatch.setattr(reports, "MOST_VALUES", 5)
    with pytest.raises(TooLargeError):
        reports.dist_stats(seven)


def test_interchange(spark, seven, tmp_path):
    graph = seven.with_properties(edge_properties={"P": {"weight": 2.0, "color": "red"}})
    document = interchange.to_hif(graph, metadata={"source": "test"})
    assert document["metadata"]["name"] == "seven" and document["metadata"]["source"] == "test"
    back = interchange.from_hif(spark, json.loads(json.dumps(document)))
    assert back == graph and back.get_properties("P", 0, "color") == "red" and back.get_properties("P", 0, "weight") == 2.0
    with pytest.raises(SetGraphError):
        interchange.from_hif(spark, {"incidences": [{"edge": "a"}]})
    interchange.to_hif(graph, str(tmp_path / "g.json"))
    assert interchange.from_hif(spark, filename=str(tmp_path / "g.json")) == graph
    interchange.to_records(graph)["incidences"].write.json(str(tmp_path / "cells"))
    assert interchange.read_records(spark, str(tmp_path / "cells")) == graph


def test_texts(spark, tmp_path):
    lines = spark.createDataFrame([("1.1.1:AB,CD;CD",), ("1.1.2:AB",)], "value string")
    scenes = texts.parse_scenes(lines)
    assert scenes.count() == 4 and sorted({r["step"] for r in scenes.collect()}) == [0, 1, 2]
    graph = texts.scene_graph(scenes)
    assert graph.shape == (2, 3) and graph.get_cell_properties("1.1.1.0", "AB", "weight") == 0.5
    assert texts.scene_graph(scenes, ("volume", "book", "chapter")).shape == (2, 2)
    names = texts.parse_names(spark.createDataFrame([("AB Alice B, a girl",), ("CD Cedric",)], "value string")).collect()
    assert [tuple(r) for r in names] == [("AB", "Alice B", "a girl"), ("CD", "Cedric", "")]
    table = spark.createDataFrame([("x", "p"), (None, "p"), ("x", "p")], "House string, Blood string")
    coded = texts.code_categories(table, ["House"])
    assert {(r["House"], r["House_code"]) for r in coded.collect()} == {("Unknown House", 0), ("x", 1)}
    assert {r["weight"] for r in texts.category_counts(table, ["House", "Blood"]).collect()} == {1, 2}
    assert texts.weight_by(table, "House") is None and texts.weight_by(texts.with_random_weight(table), "Blood").count() == 1
    (tmp_path / "l.txt").write_text("g1 d1\ng1 d2\n")
    assert texts.read_link_list(spark, str(tmp_path / "l.txt")).shape == (2, 1)
    (tmp_path / "m.csv").write_text("a,b\nc,d\n")
    assert texts.read_receivers_senders(spark, str(tmp_path / "m.csv")).count() == 2


def test_row_rules(spark):
    rows = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 1), ("b", 2.0, 2)], "k string, w double, o int")
    got = {rule: {r["k"]: r["w"] for r in props.distinct_rows(rows, "w", rule, "o").collect()}["a"] for rule in ("sum", "count", "mean", "median", "max", "min", "first", "last")}
    assert got == {"sum": 4.0, "count": 2, "mean": 2.0, "median": 2.0, "max": 3.0, "min": 1.0, "first": 1.0, "last": 3.0}
    assert props.distinct_rows(rows.select("k"), None, None).count() == 2
    with pytest.raises(ValueError):
        props.distinct_rows(rows, "w", "mode")
    pairs = spark.createDataFrame([("k1", ["x", "y"]), ("k2", ["y"])], "key string, values array<string>")
    assert {r["value"]: r["keys"] for r in props.reversed_map(pairs).collect()} == {"x": ["k1"], "y": ["k1", "k2"]}
    assert props.flatten({"a": 1, "b": {"a": 2, "c": {"d": 3}}, "e": {}}) == {"a": 1, "d": 3, "e": {}}


def test_class_map_rule(spark, dupes):
    found = {r["id"]: (r["rep"], r["members"]) for r in transforms.class_map(dupes, 1).collect()}
    assert found["F"] == ("E", 2) and found["V"] == ("V", 1)
