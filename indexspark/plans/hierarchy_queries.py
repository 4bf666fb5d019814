"""Hierarchy and network queries on a region -> nation -> supplier tree derived from the driver tables.

Roots are world regions (``R<k>``), subgoals are nations (``N<k>``, parent = their region), status layers are
suppliers (targets: their nation, and also their region when the account balance is negative, so some roots have own
layers as well as subgoals), pressure layers are part types shipped by a nation's suppliers, resilience layers are
segments of a nation's customers. Network: users -> event types from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import Tables
from . import hierarchy as H
from .registry import register


def proxy_goals(t: Tables) -> DataFrame:
    r = t.region.select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("goal"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(1.0).alias("weight"),
        (F.col("r_regionkey") + 1).cast("double").alias("order_color"),
        (F.col("r_regionkey") + 1).cast("double").alias("order_hierarchy"),
        F.col("r_name").alias("name"),
        F.concat(F.lit("region "), F.col("r_name")).alias("description"),
    )
    oh = ((F.col("n_regionkey") + 1) * 10 + F.floor(F.col("n_nationkey") / 5) + 1) / 10.0
    n = t.nation.select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("goal"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"),
        F.lit(0.5).alias("weight"),
        oh.alias("order_color"),
        oh.alias("order_hierarchy"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("nation "), F.col("n_name")).alias("description"),
    )
    return r.unionByName(n)


def proxy_catalog(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    targets = F.concat(
        F.lit("N"), F.col("s_nationkey").cast("string"),
        F.when(F.col("s_acctbal") < 0, F.concat(F.lit(" R"), F.col("n_regionkey").cast("string"))).otherwise(F.lit("")),
    )
    return s.select(
        F.concat(F.lit("sup_"), F.col("s_suppkey").cast("string")).alias("layer"),
        targets.alias("targets"),
        F.col("s_name").alias("name"),
        F.lit("supplier").alias("description"),
    )


def proxy_pressures(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("goal"), F.concat(F.lit("pt_"), F.lower("p_type")).alias("layer")
    ).distinct()


def proxy_resilience(t: Tables) -> DataFrame:
    return t.customer.select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("goal"),
        F.concat(F.lit("seg_"), F.lower("c_mktsegment")).alias("layer"),
    ).distinct()


def _all_nodes(t: Tables) -> DataFrame:
    goals = proxy_goals(t)
    cat = proxy_catalog(t)
    nodes = H.goal_nodes(goals)
    all_nodes = H.layer_nodes(nodes, H.target_bridge(cat), goals, proxy_pressures(t), proxy_resilience(t), cat)
    # the node table is metadata-sized and is read several times by the leaf filter and weights: store it once
    return stored(all_nodes, "nodes")


# ---------------------------------------------------------------- SQL fragments

GOALS_SQL = """goals AS (
  SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS goal, CAST(NULL AS VARCHAR) AS parent, 1.0 AS weight,
         CAST(r_regionkey + 1 AS DOUBLE) AS order_color, CAST(r_regionkey + 1 AS DOUBLE) AS order_hierarchy, r_name AS name,
         'region ' || r_name AS description FROM region
  UNION ALL
  SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), 0.5,
         ((n_regionkey + 1) * 10 + floor(n_nationkey / 5) + 1) / 10.0, ((n_regionkey + 1) * 10 + floor(n_nationkey / 5) + 1) / 10.0,
         n_name, 'nation ' || n_name FROM nation)"""

CATALOG_SQL = """cat AS (
  SELECT 'sup_' || CAST(s_suppkey AS VARCHAR) AS layer,
         'N' || CAST(s_nationkey AS VARCHAR) || CASE WHEN s_acctbal < 0 THEN ' R' || CAST(n_regionkey AS VARCHAR) ELSE '' END AS targets,
         s_name AS name, 'supplier' AS description
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
bridge AS (SELECT layer, t AS target, name, description FROM (SELECT *, unnest(string_split(targets, ' ')[1:3]) AS t FROM cat) WHERE t <> '')"""

MATRIX_SQL = """pm AS (SELECT DISTINCT 'N' || CAST(s_nationkey AS VARCHAR) AS goal, 'pt_' || lower(p_type) AS layer
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
rm AS (SELECT DISTINCT 'N' || CAST(c_nationkey AS VARCHAR) AS goal, 'seg_' || lower(c_mktsegment) AS layer FROM customer)"""

NODES_SQL = f"""{GOALS_SQL}, {CATALOG_SQL}, {MATRIX_SQL},
gn AS (
  SELECT goal AS id, name, CASE WHEN parent IS NULL THEN 'goal' ELSE 'subgoal' END AS category,
         CASE WHEN parent IS NULL THEN goal ELSE parent || '-' || goal END AS path, order_color AS "order", description FROM goals
  UNION ALL
  SELECT goal, name, 'goal', goal || '-' || goal, order_color, description FROM goals WHERE parent IS NULL),
tp AS (SELECT id AS target, path AS parent FROM gn WHERE path LIKE '%-%'),
nodes AS (
  SELECT * FROM gn
  UNION ALL
  SELECT 's_' || b.layer, b.name, 'status', coalesce(tp.parent, 'NA') || '-s_' || b.layer, 100.0, b.description
  FROM bridge b LEFT JOIN tp ON tp.target = b.target WHERE b.target IN (SELECT goal FROM goals)
  UNION ALL
  SELECT 'p_' || x.layer, c.name, 'pressure', coalesce(x.parent, 'NA') || '-p_' || x.layer, 200.0, c.description
  FROM (SELECT DISTINCT pm.goal AS target, pm.layer, tp.parent FROM pm LEFT JOIN tp ON tp.target = pm.goal) x LEFT JOIN cat c ON c.layer = x.layer
  UNION ALL
  SELECT 'r_' || x.layer, c.name, 'resilience', coalesce(x.parent, 'NA') || '-r_' || x.layer, 300.0, c.description
  FROM (SELECT DISTINCT rm.goal AS target, rm.layer, tp.parent FROM rm LEFT JOIN tp ON tp.target = rm.goal) x LEFT JOIN cat c ON c.layer = x.layer)"""

LEAF_SQL = f"""{NODES_SQL},
pre AS (SELECT DISTINCT array_to_string(string_split(path, '-')[1:k], '-') AS p
        FROM nodes, range(1, 64) r(k) WHERE k < len(string_split(path, '-'))),
leaves AS (SELECT * FROM nodes WHERE len(string_split(path, '-')) - 1 >= 2 AND path NOT IN (SELECT p FROM pre))"""


@register("target_bridge", f"WITH {CATALOG_SQL} SELECT layer, target, name, description FROM bridge")
def q_target_bridge(spark, sf):
    return H.target_bridge(proxy_catalog(Tables(spark, sf))).select("layer", "target", "name", "description")


@register(
    "target_labels",
    f"""WITH {GOALS_SQL}, {CATALOG_SQL},
known AS (SELECT goal AS target, order_hierarchy, name FROM goals
          UNION ALL SELECT * FROM (VALUES ('pressures', 100.0, 'pressures'), ('resilience', 101.0, 'resilience'), ('spatial', 102.0, 'spatial')) v(target, order_hierarchy, name))
SELECT t.target, k.order_hierarchy, k.name,
       regexp_replace(CAST(k.order_hierarchy AS VARCHAR), '\\.0$', '') || ' ' || k.name || ' (' || t.target || ')' AS target_label
FROM (SELECT DISTINCT target FROM bridge) t LEFT JOIN known k ON k.target = t.target""",
)
def q_target_labels(spark, sf):
    t = Tables(spark, sf)
    return H.target_labels(H.target_bridge(proxy_catalog(t)), proxy_goals(t))


@register("goal_paths", f"""WITH {NODES_SQL} SELECT id, name, category, path, "order", description FROM gn""")
def q_goal_paths(spark, sf):
    return H.goal_nodes(proxy_goals(Tables(spark, sf)))


@register("layer_paths", f"""WITH {NODES_SQL} SELECT id, name, category, path, "order", description FROM nodes""")
def q_layer_paths(spark, sf):
    return _all_nodes(Tables(spark, sf))


@register("leaf_paths", f"""WITH {LEAF_SQL} SELECT id, category, path FROM leaves""")
def q_leaf_paths(spark, sf):
    return H.leaf_paths(_all_nodes(Tables(spark, sf))).select("id", "category", "path")


@register(
    "apportion_weight",
    f"""WITH {LEAF_SQL},
p AS (SELECT l.path, l.category, regexp_replace(l.path, '(.+)-(.+)-(.+)', '\\1') AS path1, regexp_replace(l.path, '(.+)-(.+)-(.+)', '\\2') AS path2
      FROM leaves l),
p2 AS (SELECT p.*, g2.weight AS path2_weight, g1.weight AS path1_weight FROM p
       LEFT JOIN goals g2 ON g2.goal = p.path2 LEFT JOIN goals g1 ON g1.goal = p.path1),
own AS (SELECT DISTINCT path1 FROM p2 WHERE path2 IN (SELECT DISTINCT parent FROM goals WHERE parent IS NOT NULL)),
b1 AS (SELECT path, category, path2_weight / count(*) OVER (PARTITION BY path2, path2_weight) AS layer_weight,
              CAST(NULL AS DOUBLE) AS layers_weight
       FROM p2 WHERE path1 NOT IN (SELECT path1 FROM own)),
b2a AS (SELECT *, path1_weight / count(*) OVER (PARTITION BY path1, path1_weight) AS layers_weight FROM p2 WHERE path1 IN (SELECT path1 FROM own)),
b2 AS (SELECT path, category,
              CASE WHEN path2 IN (SELECT path1 FROM own) THEN layers_weight
                   ELSE (path2_weight - layers_weight) / count(*) OVER (PARTITION BY path2, path2_weight) END AS layer_weight, layers_weight
       FROM b2a)
SELECT path, category, round(layer_weight, 6) AS layer_weight, round(layers_weight, 6) AS layers_weight FROM b1
UNION ALL SELECT path, category, round(layer_weight, 6), round(layers_weight, 6) FROM b2""",
)
def q_apportion_weight(spark, sf):
    t = Tables(spark, sf)
    w = H.apportion_weights(H.leaf_paths(_all_nodes(t)), proxy_goals(t))
    return w.select("path", "category", F.round("layer_weight", 6).alias("layer_weight"), F.round("layers_weight", 6).alias("layers_weight"))


@register(
    "id_order",
    f"""WITH {NODES_SQL},
ids AS (SELECT DISTINCT id, CAST("order" AS DOUBLE) AS "order" FROM nodes
        UNION ALL SELECT * FROM (VALUES ('pressure', -3.0), ('resilience', -2.0), ('status', -1.0)) v(id, "order"))
SELECT id, "order", row_number() OVER (ORDER BY "order", id) AS d, id || ':' || CAST(row_number() OVER (ORDER BY "order", id) AS VARCHAR) AS s
FROM ids""",
)
def q_id_order(spark, sf):
    return H.id_order(_all_nodes(Tables(spark, sf))).select("id", "order", "d", "s")


# ---------------------------------------------------------------- a tree of four levels

_DEEP_SQL = """g AS (SELECT 'W' AS goal, CAST(NULL AS VARCHAR) AS parent, CAST(1 AS DOUBLE) AS weight
  UNION ALL SELECT 'R' || r_regionkey, 'W', CAST(r_regionkey + 1 AS DOUBLE) FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, CAST(n_nationkey % 4 + 1 AS DOUBLE) FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, CAST(s_acctbal + 1000 AS DOUBLE) FROM supplier),
own AS (SELECT DISTINCT 'S' || l_suppkey AS goal, lower(p_type) AS layer FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT 'N' || c_nationkey, lower(c_mktsegment) FROM customer)"""


def _deep_tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """World, regions, nations, suppliers; nations have layers beside their suppliers' (segments, shipped part types)."""
    code = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    goals = t.spark.createDataFrame([("W", None, 1.0)], "goal string, parent string, weight double")
    goals = goals.unionByName(t.region.select(code("R", "r_regionkey").alias("goal"), F.lit("W").alias("parent"), (F.col("r_regionkey") + 1).cast("double").alias("weight")))
    goals = goals.unionByName(t.nation.select(code("N", "n_nationkey").alias("goal"), code("R", "n_regionkey").alias("parent"), (F.col("n_nationkey") % 4 + 1).cast("double").alias("weight")))
    goals = goals.unionByName(t.supplier.select(code("S", "s_suppkey").alias("goal"), code("N", "s_nationkey").alias("parent"), (F.col("s_acctbal") + 1000).cast("double").alias("weight")))
    shipped = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    own = shipped.select(code("S", "l_suppkey").alias("goal"), F.lower("p_type").alias("layer"))
    own = own.unionByName(t.customer.select(code("N", "c_nationkey").alias("goal"), F.lower("c_mktsegment").alias("layer"))).distinct()
    return goals, own


@register(
    "tree_paths",
    f"""WITH RECURSIVE {_DEEP_SQL},
p AS (SELECT goal, parent, goal AS path, 0 AS depth FROM g WHERE parent IS NULL
      UNION ALL SELECT g.goal, g.parent, p.path || '-' || g.goal, p.depth + 1 FROM g JOIN p ON g.parent = p.goal)
SELECT * FROM p""",
)
def q_tree_paths(spark, sf):
    return H.tree_paths(_deep_tree(Tables(spark, sf))[0])


@register(
    "tree_weights",
    f"""WITH RECURSIVE {_DEEP_SQL},
p AS (SELECT goal, parent, goal AS path, 0 AS depth FROM g WHERE parent IS NULL
      UNION ALL SELECT g.goal, g.parent, p.path || '-' || g.goal, p.depth + 1 FROM g JOIN p ON g.parent = p.goal),
n AS (SELECT p.*, g.weight, (SELECT count(*) FROM own WHERE own.goal = p.goal) AS own,
             (SELECT count(*) FROM own JOIN p q ON q.goal = own.goal WHERE q.path = p.path OR starts_with(q.path, p.path || '-')) AS leaves FROM p JOIN g USING (goal)),
s AS (SELECT *, weight / sum(weight) FILTER (WHERE leaves > 0) OVER (PARTITION BY parent) AS part FROM n),
w AS (SELECT goal, path, own, leaves, weight AS has FROM s WHERE depth = 0
      UNION ALL SELECT s.goal, s.path, s.own, s.leaves, w.has * (1 - w.own / w.leaves) * s.part FROM s JOIN w ON s.parent = w.goal WHERE s.leaves > 0)
SELECT w.path || '-' || layer AS path, goal, layer, round(has / leaves, 9) AS layer_weight FROM w JOIN own USING (goal)""",
)
def q_tree_weights(spark, sf):
    w = H.tree_weights(*_deep_tree(Tables(spark, sf)))
    return w.select("path", "goal", "layer", F.round("layer_weight", 9).alias("layer_weight"))


# ---------------------------------------------------------------- network

NET_SQL = """nodes AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS id, CASE WHEN count(*) OVER (PARTITION BY user_id) >= 70 THEN 'active' ELSE 'user' END AS "group" FROM events
               UNION ALL SELECT DISTINCT event_type, 'event' FROM events),
edges AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS "from", event_type AS "to" FROM events)"""


def _network(t: Tables):
    ev = t.events
    users = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("n") >= 70, "active").otherwise("user").alias("group")
    )
    types = ev.select(F.col("event_type").alias("id")).distinct().withColumn("group", F.lit("event"))
    edges = ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("from"), F.col("event_type").alias("to")).distinct()
    return users.unionByName(types), edges


@register(
    "induced_subgraph",
    f"""WITH {NET_SQL},
n AS (SELECT * FROM nodes WHERE "group" IN ('active', 'event'))
SELECT "from", "to" FROM edges WHERE "from" IN (SELECT id FROM n) AND "to" IN (SELECT id FROM n)""",
)
def q_induced_subgraph(spark, sf):
    nodes, edges = _network(Tables(spark, sf))
    return H.induced_subgraph(nodes, edges, ["active", "event"])[1]


@register(
    "one_hop",
    f"""WITH {NET_SQL},
e AS (SELECT * FROM edges WHERE "from" = 'error' OR "to" = 'error')
SELECT id, "group" FROM nodes WHERE id IN (SELECT "from" FROM e UNION SELECT "to" FROM e)""",
)
def q_one_hop(spark, sf):
    nodes, edges = _network(Tables(spark, sf))
    return H.one_hop(nodes, edges, "error")[0]
