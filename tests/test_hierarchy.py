"""Hierarchy build on a hand-made goal tree: leaf filter and the two-branch weight apportionment."""

from indexspark.plans import hierarchy as H
from indexspark.sources.layers import catalog_frame

GOALS = [
    ("FP", None, 1.0, 1.2, 1.0, "Food", "d"), ("FIS", "FP", 0.5, 1.1, 1.1, "Fish", "d"), ("MAR", "FP", 0.5, 1.3, 1.2, "Mar", "d"),
    ("AO", None, 1.0, 2.0, 2.0, "AO", "d"),
]
SCHEMA = "goal string, parent string, weight double, order_color double, order_hierarchy double, name string, description string"


def test_paths_leaves_and_weights(spark):
    goals = spark.createDataFrame(GOALS, SCHEMA)
    cat = catalog_frame(spark, [
        dict(layer="l1", targets="FIS", name="L1"), dict(layer="l2", targets="FIS", name="L2"), dict(layer="l3", targets="MAR"),
        dict(layer="l4", targets="FP"), dict(layer="l5", targets="AO pressures"),
    ]).select("layer", "targets", "name", "description")
    empty = spark.createDataFrame([], "goal string, layer string")
    nodes = H.goal_nodes(goals)
    assert {r.path for r in nodes.collect()} == {"FP", "FP-FIS", "FP-MAR", "AO", "FP-FP", "AO-AO"}
    allnodes = H.layer_nodes(nodes, H.target_bridge(cat), goals, empty, empty, cat).checkpoint()
    leaves = H.leaf_paths(allnodes)
    assert {r.path for r in leaves.collect()} == {"FP-FIS-s_l1", "FP-FIS-s_l2", "FP-MAR-s_l3", "FP-FP-s_l4", "AO-AO-s_l5"}
    w = {r.path: r.layer_weight for r in H.apportion_weights(leaves, goals).collect()}
    assert w == {"AO-AO-s_l5": 1.0, "FP-FP-s_l4": 0.25, "FP-FIS-s_l1": 0.125, "FP-FIS-s_l2": 0.125, "FP-MAR-s_l3": 0.25}
    order = H.id_order(allnodes).orderBy("d").collect()
    assert [r.d for r in order] == list(range(1, len(order) + 1))
    assert order[0].id == "pressure" and order[0].s == "pressure:1"
    labels = {r.target: r.target_label for r in H.target_labels(H.target_bridge(cat), goals).collect()}
    assert labels["FIS"] == "1.1 Fish (FIS)" and labels["pressures"] == "100 pressures (pressures)"


def test_network(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, `group` string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b")], "`from` string, `to` string")
    n, e = H.induced_subgraph(nodes, edges, ["x"])
    assert n.count() == 2 and [(r["from"], r["to"]) for r in e.collect()] == [("a", "b")]
    n2, e2 = H.one_hop(nodes, edges, "c")
    assert {r.id for r in n2.collect()} == {"a", "b", "c"} and e2.count() == 2
