"""Goal -> subgoal -> layer hierarchy (H1-H7) and network subsets (H8, H9).

Inputs are small metadata tables in DataFrame form: ``goals(goal, parent, weight, order_color, order_hierarchy, name,
description)``, a layer catalog ``(layer, targets, name, description)``, and the long pressure/resilience matrices
``(goal, layer)``. Node paths are dash-separated (``goal``, ``parent-goal``, ``parent-goal-x_layer``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import format_g, isin_safe, safe_div
from ..operators.filters import leaf_paths as _leaf_paths
from ..operators.joins import assert_no_rows
from ..operators.reshape import explode_targets
from ..operators.windows import count_in, global_row_number
from ..session import stored

NODE_COLUMNS = ["id", "name", "category", "path", "order", "description"]
# fixed values: order of the three layer categories and of the pseudo-targets
LAYER_CATEGORY_ORDER = [("pressure", -3), ("resilience", -2), ("status", -1)]
PSEUDO_TARGETS = [("pressures", 100.0, "pressures"), ("resilience", 101.0, "resilience"), ("spatial", 102.0, "spatial")]


def target_bridge(catalog: DataFrame) -> DataFrame:
    """H1: one row per (layer, target) from the space-separated ``targets`` (all of them), catalog columns kept."""
    return explode_targets(catalog, "targets", "target").drop("targets")


def target_labels(bridge: DataFrame, goals: DataFrame) -> DataFrame:
    """H2: available targets with hierarchy order and label ``'%g name (code)'``; three pseudo-targets added."""
    spark = bridge.sparkSession
    known = goals.select(F.col("goal").alias("target"), "order_hierarchy", "name").unionByName(
        spark.createDataFrame(PSEUDO_TARGETS, "target string, order_hierarchy double, name string")
    )
    t = bridge.select("target").distinct().join(known, "target", "left")
    return t.select(
        "target", "order_hierarchy", "name",
        F.format_string("%s %s (%s)", format_g("order_hierarchy"), F.col("name"), F.col("target")).alias("target_label"),
    )


def goal_nodes(goals: DataFrame) -> DataFrame:
    """H3: goal/subgoal nodes; each non-subgoal also gets a ``g-g`` element so subgoal-less goals have depth."""
    is_root = F.col("parent").isNull()
    nodes = goals.select(
        F.col("goal").alias("id"),
        "name",
        F.when(is_root, "goal").otherwise("subgoal").alias("category"),
        F.when(is_root, F.col("goal")).otherwise(F.concat_ws("-", "parent", "goal")).alias("path"),
        F.col("order_color").alias("order"),
        "description",
    )
    subgoal_ids = goals.where(~is_root).select(F.col("goal").alias("id"))
    selfs = nodes.join(subgoal_ids, "id", "left_anti").withColumn("path", F.concat_ws("-", "id", "id"))
    return nodes.unionByName(selfs)


def layer_nodes(nodes: DataFrame, bridge: DataFrame, goals: DataFrame, pressures: DataFrame, resilience: DataFrame,
                layers: DataFrame) -> DataFrame:
    """H4: status (s_), pressure (p_) and resilience (r_) layer leaves under each target's path."""
    targets_path = nodes.where(F.col("path").contains("-")).select(F.col("id").alias("target"), F.col("path").alias("parent"))
    goal_codes = goals.select(F.col("goal").alias("target"))

    def leaves(df: DataFrame, prefix: str, category: str, order: float) -> DataFrame:
        j = df.join(targets_path, "target", "left")
        return j.select(
            F.concat(F.lit(prefix), "layer").alias("id"),
            "name",
            F.lit(category).alias("category"),
            F.concat(F.coalesce("parent", F.lit("NA")), F.lit(f"-{prefix}"), "layer").alias("path"),
            F.lit(order).alias("order"),
            "description",
        )

    status = leaves(bridge.join(goal_codes, "target", "left_semi").select("layer", "target", "name", "description"), "s_", "status", 100.0)
    meta = layers.select("layer", "name", "description")
    pr = pressures.select(F.col("goal").alias("target"), "layer").join(targets_path, "target", "left").distinct()
    pr = pr.drop("parent").join(meta, "layer", "left")
    rs = resilience.select(F.col("goal").alias("target"), "layer").join(targets_path, "target", "left").distinct()
    rs = rs.drop("parent").join(meta, "layer", "left")
    return nodes.unionByName(status).unionByName(leaves(pr, "p_", "pressure", 200.0)).unionByName(leaves(rs, "r_", "resilience", 300.0))


def leaf_paths(all_nodes: DataFrame) -> DataFrame:
    """H5: terminal paths with at least two dashes."""
    return _leaf_paths(all_nodes, "path", "-", 2)


def apportion_weights(paths: DataFrame, goals: DataFrame, materialize: bool = True) -> DataFrame:
    """H6: split goal weights over leaf layers.

    Branch 1 (root without own layers): ``layer_weight = path2_weight / n(path2)``. Branch 2 (root with subgoals and
    own ``root-root-layer`` leaves): ``share = path1_weight / n(path1)`` over all leaves of the root; own leaves get
    ``share``; subgoal leaves get ``(path2_weight - share) / n(path2)``. The path table is stored (it is
    metadata-sized and read by both branches) so the plan does not repeat the hierarchy build per branch.
    """
    p = paths.withColumns(
        {
            "path1": F.regexp_replace("path", "(.+)-(.+)-(.+)", "$1"),
            "path2": F.regexp_replace("path", "(.+)-(.+)-(.+)", "$2"),
        }
    )
    gw = goals.select("goal", "weight")
    p = p.join(gw.withColumnsRenamed({"goal": "path2", "weight": "path2_weight"}), "path2", "left")
    p = p.join(gw.withColumnsRenamed({"goal": "path1", "weight": "path1_weight"}), "path1", "left")
    with_sub = goals.where(F.col("parent").isNotNull()).select(F.col("parent").alias("path2")).distinct()
    own = p.join(with_sub, "path2", "left_semi").select("path1").distinct().withColumn("__own", F.lit(True))
    p = p.join(own, "path1", "left").withColumn("__own", F.coalesce("__own", F.lit(False)))
    if materialize:  # one row per leaf path (metadata-sized); read four times below
        p = stored(p, "paths")
        own = p.where("__own").select("path1").distinct()
    b1 = p.where(~F.col("__own")).withColumn("layer_weight", F.col("path2_weight") / count_in(["path2", "path2_weight"]))
    b2 = p.where(F.col("__own")).withColumn("layers_weight", F.col("path1_weight") / count_in(["path1", "path1_weight"]))
    own_codes = own.select(F.col("path1").alias("__code")).withColumn("__is_own", F.lit(True))
    b2 = b2.join(own_codes, F.col("path2") == F.col("__code"), "left").withColumn(
        "layer_weight",
        F.when(F.coalesce("__is_own", F.lit(False)), F.col("layers_weight")).otherwise(
            (F.col("path2_weight") - F.col("layers_weight")) / count_in(["path2", "path2_weight"])
        ),
    ).drop("__code", "__is_own")
    return b1.withColumn("layers_weight", F.lit(None).cast("double")).unionByName(b2).drop("__own")


def id_order(all_nodes: DataFrame) -> DataFrame:
    """H7: distinct (id, order) plus the three layer categories at -3..-1, numbered by (order, id): ``d`` and
    ``'id:d'``. The numbering is a distributed global row number (range partitions + per-partition offsets)."""
    spark = all_nodes.sparkSession
    ids = all_nodes.select("id", F.col("order").cast("double").alias("order")).distinct().unionByName(
        spark.createDataFrame([(k, float(v)) for k, v in LAYER_CATEGORY_ORDER], "id string, order double")
    )
    out = global_row_number(ids, ["order", "id"], "d")
    return out.withColumn("s", F.concat_ws(":", "id", F.col("d").cast("string")))


# ---------------------------------------------------------------- H8, H9 network subsets


def induced_subgraph(nodes: DataFrame, edges: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """H8: nodes of the selected groups, and the edges whose two ends are both among them (two semi joins)."""
    n = nodes.where(isin_safe("group", list(groups)))
    ids = n.select("id")
    e = edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    return n, e.select("from", "to")


def one_hop(nodes: DataFrame, edges: DataFrame, selected: str) -> tuple[DataFrame, DataFrame]:
    """H9: edges touching the selected node and the nodes at their ends."""
    e = edges.where((F.col("from") == selected) | (F.col("to") == selected)).select("from", "to")
    ends = e.select(F.col("from").alias("id")).unionByName(e.select(F.col("to").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_semi"), e


def sunburst_weights(goals: DataFrame, catalog: DataFrame, pressures_long: DataFrame, resilience_long: DataFrame) -> DataFrame:
    """E3 end to end: goal tree + layer catalog + long matrices -> leaf ``(path, category, layer_weight)``.

    The node table is stored (metadata-sized, read by the leaf filter and both weight branches).
    """
    bridge = target_bridge(catalog.select("layer", "targets", "name", "description"))
    nodes = goal_nodes(goals)
    all_nodes = layer_nodes(
        nodes, bridge, goals, pressures_long.select("goal", "layer"), resilience_long.select("goal", "layer"),
        catalog.select("layer", "name", "description"),
    )
    all_nodes = stored(all_nodes, "nodes")
    return apportion_weights(leaf_paths(all_nodes), goals).select("path", "category", "layer_weight")


# ---------------------------------------------------------------- trees of any depth


def tree_paths(goals: DataFrame, sep: str = "-") -> DataFrame:
    """H3 for any depth: ``goal, parent, path, depth`` of every goal, roots at depth 0, paths joined from the root down.

    One join per level on the goals found so far in the level above. A goal that no root reaches (a cycle, a parent that
    is not a goal) and a goal listed twice stop it.
    """
    table = stored(goals.select("goal", "parent"), "tree")
    twice = table.groupBy("goal").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    assert_no_rows(twice, "goals listed more than once")
    level = table.where(F.col("parent").isNull()).select("goal", "parent", F.col("goal").alias("path"), F.lit(0).alias("depth"))
    levels = [stored(level, "tree-level")]
    while not levels[-1].isEmpty():
        above = levels[-1].select(F.col("goal").alias("__above"), F.col("path").alias("__path"))
        below = table.join(above, F.col("parent") == F.col("__above"))
        levels.append(stored(below.select("goal", "parent", F.concat_ws(sep, "__path", "goal").alias("path"), F.lit(len(levels)).alias("depth")), "tree-level"))
    found = levels[0]
    for lv in levels[1:-1]:
        found = found.unionByName(lv)
    assert_no_rows(table.join(found.select("goal"), "goal", "left_anti"), "goals that no root reaches (a cycle, or a parent that is missing)")
    return found


def tree_weights(goals: DataFrame, layers: DataFrame, sep: str = "-") -> DataFrame:
    """H4-H6 for any depth: ``path, goal, layer, layer_weight`` of every leaf, weights passed down level by level.

    ``goals(goal, parent, weight)``, ``layers(goal, layer)``. A root has its own weight. Of a goal's weight its own layers
    take their share among all layers below it, in equal parts; the rest goes to the subgoals below which there is a
    layer, by their weights (alike where none has one). So the leaves of a root add up to its weight.
    """
    paths = tree_paths(goals, sep)
    depth = paths.agg(F.max("depth")).first()[0]
    nodes = paths.join(goals.select("goal", "weight"), "goal")
    own = layers.select("goal", "layer").distinct()
    counts = own.groupBy("goal").agg(F.count(F.lit(1)).alias("own"))
    nodes = stored(nodes.join(counts, "goal", "left").fillna({"own": 0}), "tree-nodes")
    if depth is None:
        return nodes.select("path", "goal", F.lit("").alias("layer"), "weight").withColumnRenamed("weight", "layer_weight")
    below = nodes.where(F.col("depth") == depth).select("goal", "parent", F.col("own").alias("leaves"))
    sizes = [stored(below, "tree-sizes")]  # of the deepest level first
    for d in reversed(range(depth)):
        under = sizes[-1].groupBy(F.col("parent").alias("goal")).agg(F.sum("leaves").alias("under"))
        here = nodes.where(F.col("depth") == d).join(under, "goal", "left")
        sizes.append(stored(here.select("goal", "parent", (F.col("own") + F.coalesce("under", F.lit(0))).alias("leaves")), "tree-sizes"))
    passed = nodes.where("depth = 0").join(sizes[-1].select("goal", "leaves"), "goal").select("goal", "path", "own", "leaves", F.col("weight").alias("has"))
    done = [stored(passed, "tree-weights")]
    for d in range(1, depth + 1):
        above = done[-1].select(F.col("goal").alias("parent"), (F.col("has") * (1 - safe_div("own", "leaves"))).alias("left"))
        live = nodes.where(F.col("depth") == d).join(sizes[-1 - d].select("goal", "leaves"), "goal").where("leaves > 0").join(above, "parent")
        total = live.groupBy("parent").agg(F.sum("weight").alias("__all"), F.count(F.lit(1)).alias("__n"))
        share = F.when(F.col("__all") > 0, F.coalesce("weight", F.lit(0.0)) / F.col("__all")).otherwise(1 / F.col("__n"))
        done.append(stored(live.join(total, "parent").select("goal", "path", "own", "leaves", (F.col("left") * share).alias("has")), "tree-weights"))
    all_ = done[0]
    for lv in done[1:]:
        all_ = all_.unionByName(lv)
    leaf = all_.join(own, "goal")
    return leaf.select(F.concat_ws(sep, "path", "layer").alias("path"), "goal", "layer", safe_div("has", "leaves").alias("layer_weight"))
