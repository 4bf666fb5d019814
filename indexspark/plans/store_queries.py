"""Layer-store queries (S2-S7, S10): narrow aggregates of the driver tables projected onto the long layer schema,
then selected by name, by list, by target and with labels; reference-point union; scenario patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layers import LayerStore, layer_target_bridge, to_long
from ..sources.tables import Tables, order_facts
from . import composite as C
from .registry import register


def _long_store(t: Tables) -> LayerStore:
    of = order_facts(t)
    rev = of.groupBy((F.col("c_nationkey") + 1).alias("rgn_id"), "year").agg(F.sum("o_totalprice").alias("v"))
    seg = of.groupBy((F.col("c_nationkey") + 1).alias("rgn_id"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    seg = seg.withColumn("v", F.col("n") / F.sum("n").over(Window.partitionBy("rgn_id")))
    sup = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        to_long(rev, "nation_revenue", id_num="rgn_id", year="year", val_num=F.round("v", 2)),
        to_long(seg, "segment_share", id_num="rgn_id", category="c_mktsegment", val_num=F.round("v", 6)),
        to_long(sup, "supplier_nation", id_num="s_suppkey", id_chr="s_name", val_chr="n_name"),
    ]
    return LayerStore(parts[0].unionByName(parts[1]).unionByName(parts[2]))


LONG_SQL = """lng AS (
  SELECT 'nation_revenue' AS layer, c_nationkey + 1 AS id_num, CAST(NULL AS VARCHAR) AS id_chr, CAST(NULL AS VARCHAR) AS category,
         CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS val_num, CAST(NULL AS VARCHAR) AS val_chr
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate)
  UNION ALL
  SELECT 'segment_share', rgn_id, NULL, c_mktsegment, NULL, round(n / sum(n) OVER (PARTITION BY rgn_id), 6), NULL
  FROM (SELECT c_nationkey + 1 AS rgn_id, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
  UNION ALL
  SELECT 'supplier_nation', CAST(s_suppkey AS INTEGER), s_name, NULL, NULL, NULL, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

# fixed values: the catalog targets of the three example layers
EXAMPLE_TARGETS = [("nation_revenue", "TR LE"), ("segment_share", "LE"), ("supplier_nation", "spatial")]


@register("layer_long_union", f"WITH {LONG_SQL} SELECT * FROM lng")
def q_layer_long_union(spark, sf):
    return _long_store(Tables(spark, sf)).df


@register("layer_select", f"WITH {LONG_SQL} SELECT id_num AS rgn_id, year, val_num AS revenue FROM lng WHERE layer = 'nation_revenue'")
def q_layer_select(spark, sf):
    return _long_store(Tables(spark, sf)).narrow("nation_revenue", id_num="rgn_id", year="year", val_num="revenue")


@register(
    "layer_select_many",
    f"WITH {LONG_SQL} SELECT layer, id_num, category, year, val_num FROM lng WHERE layer IN ('nation_revenue', 'segment_share')",
)
def q_layer_select_many(spark, sf):
    return _long_store(Tables(spark, sf)).select_many(["nation_revenue", "segment_share"]).select("layer", "id_num", "category", "year", "val_num")


@register(
    "layer_by_target",
    f"""WITH {LONG_SQL}, tg AS (SELECT * FROM (VALUES ('nation_revenue', 'TR LE'), ('segment_share', 'LE'), ('supplier_nation', 'spatial')) v(layer, targets))
SELECT layer, id_num, category, year, val_num FROM lng
WHERE layer IN (SELECT layer FROM (SELECT layer, unnest(string_split(targets, ' ')) AS target FROM tg) WHERE target = 'LE')""",
)
def q_layer_by_target(spark, sf):
    cat = spark.createDataFrame(EXAMPLE_TARGETS, "layer string, targets string")
    bridge = layer_target_bridge(cat)
    return _long_store(Tables(spark, sf)).by_target("LE", bridge).select("layer", "id_num", "category", "year", "val_num")


@register(
    "layer_alias",
    f"""WITH {LONG_SQL}
SELECT CASE layer WHEN 'nation_revenue' THEN 'status' ELSE 'trend' END AS dimension, id_num AS region_id, category, year, val_num AS score
FROM lng WHERE layer IN ('nation_revenue', 'segment_share')""",
)
def q_layer_alias(spark, sf):
    d = _long_store(Tables(spark, sf)).alias({"nation_revenue": "status", "segment_share": "trend"})
    return d.select(F.col("layer").alias("dimension"), F.col("id_num").alias("region_id"), "category", "year", F.col("val_num").alias("score"))


# ---------------------------------------------------------------- S10 scenario patch

PATCH_SQL = """a AS (SELECT c_nationkey + 1 AS region_id, 'REV' AS goal, 'status' AS dimension, round(avg(o_totalprice) / 1000, 6) AS score
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT c_nationkey + 1 AS region_id, 'REV' AS goal, 'status' AS dimension, round(avg(o_totalprice) / 1000, 6) AS score
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1),
k AS (SELECT 'REV' AS goal, 'status' AS dimension, n_nationkey + 1 AS region_id FROM nation JOIN region ON n_regionkey = r_regionkey
      WHERE r_name = 'AMERICA')"""


def _patch_frames(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    of = order_facts(t)

    def by_status(st: str) -> DataFrame:
        return of.where(F.col("o_orderstatus") == st).groupBy((F.col("c_nationkey") + 1).alias("region_id")).agg(
            F.lit("REV").alias("goal"), F.lit("status").alias("dimension"), F.round(F.avg("o_totalprice") / 1000, 6).alias("score")
        )

    keys = (
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .where(F.col("r_name") == "AMERICA")
        .select(F.lit("REV").alias("goal"), F.lit("status").alias("dimension"), (F.col("n_nationkey") + 1).alias("region_id"))
    )
    return by_status("F"), by_status("O"), keys


@register(
    "scenario_patch",
    f"""WITH {PATCH_SQL}
SELECT * FROM a WHERE region_id NOT IN (SELECT region_id FROM k)
UNION ALL SELECT * FROM b WHERE region_id IN (SELECT region_id FROM k)""",
)
def q_scenario_patch(spark, sf):
    a, b, k = _patch_frames(Tables(spark, sf))
    return C.scenario_patch(a.select("region_id", "goal", "dimension", "score"), b, k)
