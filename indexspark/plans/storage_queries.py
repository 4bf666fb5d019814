"""Ingest and storage queries (S1, S2, S7-S11): driver tables written as CSV layers and read back through a catalog, a
layer snapshot that follows its inputs, scores of several scenarios with replaced slices, the reports of a run, and goals
scheduled by what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from ..sources import scores as SC
from ..sources.layers import LayerStore, catalog_frame, ingest_catalog
from ..sources.tables import Tables
from . import goals as G
from . import metadata as M
from .goal_oracles import REFPOINTS_SQL
from .goal_queries import AO_SQL, CW_SQL, HAB_CONTRIB_SQL, REFERENCE_GOALS, SPP_SQL, store_for
from .registry import register
from .scenario import run_leaf_goals
from .schedule import GoalJob, leaf_jobs, run_goals
from .store_queries import LONG_SQL, PATCH_SQL, _long_store, _patch_frames

# the catalog of the CSV layers: each file with a header of its own, field names in another case than the files'
CSV_LAYERS = [
    dict(layer="nation_revenue", filename="nation_revenue.csv", targets="TR LE", fld_id_num="RGN_ID", fld_year="year", fld_val_num="Revenue"),
    dict(layer="segment_share", filename="segment_share.csv", targets="LE", fld_id_num="rgn_id", fld_category="sector", fld_val_num="value"),
    dict(layer="supplier_nation", filename="supplier_nation.csv", targets="spatial", fld_id_num="rgn_id", fld_id_chr="supplier", fld_val_chr="label"),
]


def _write_csv_layers(t: Tables, root: str) -> None:
    """Each layer as a folder of CSV part files, as a job upstream would leave it."""
    long = _long_store(t)
    frames = {
        "nation_revenue": long.narrow("nation_revenue", id_num="rgn_id", year="Year", val_num="revenue"),
        "segment_share": long.narrow("segment_share", id_num="rgn_id", category="sector", val_num="value"),
        "supplier_nation": long.narrow("supplier_nation", id_num="rgn_id", id_chr="supplier", val_chr="label"),
    }
    for name, df in frames.items():
        df.write.option("header", True).option("quoteAll", True).option("nullValue", "NA").csv(f"{root}/{name}.csv")


def _ingested(spark, sf) -> tuple[LayerStore, str, DataFrame]:
    root = scratch_path(spark, "csv-layers")
    _write_csv_layers(Tables(spark, sf), root)
    catalog = catalog_frame(spark, CSV_LAYERS)
    return ingest_catalog(spark, catalog, root), root, catalog


@register("catalog_ingest", f"WITH {LONG_SQL} SELECT * FROM lng")
def q_catalog_ingest(spark, sf):
    return _ingested(spark, sf)[0].df


@register("layer_snapshot", f"WITH {LONG_SQL} SELECT * FROM lng WHERE layer <> 'supplier_nation' OR id_num % 2 = 0")
def q_layer_snapshot(spark, sf):
    """A snapshot is made, an input file is written anew with half its rows, and the snapshot follows."""
    store, root, catalog = _ingested(spark, sf)
    path = scratch_path(spark, "snapshot")
    take = lambda: LayerStore.snapshot(spark, path, lambda: ingest_catalog(spark, catalog, root), [root], catalog)
    take()
    half = store.narrow("supplier_nation", id_num="rgn_id", id_chr="supplier", val_chr="label").where("rgn_id % 2 = 0")
    stored(half, "csv-half").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{root}/supplier_nation.csv")
    return take().df


@register(
    "scenario_store",
    f"""WITH {PATCH_SQL},
f AS (SELECT region_id, 'REV' AS goal, dimension, score FROM a),
n AS (SELECT c_nationkey + 1 AS region_id, 'ORD' AS goal, 'status' AS dimension, CAST(count(*) AS DOUBLE) AS score
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT 'open' AS scenario, goal, dimension, region_id, score FROM b
UNION ALL SELECT 'open', goal, dimension, region_id, score * 2 FROM n
UNION ALL SELECT 'filled', goal, dimension, region_id, score FROM f WHERE region_id NOT IN (SELECT region_id FROM k)
UNION ALL SELECT 'filled', goal, dimension, region_id, score FROM b WHERE region_id IN (SELECT region_id FROM k)
UNION ALL SELECT 'filled', goal, dimension, region_id, score FROM n""",
)
def q_scenario_store(spark, sf):
    """Two scenarios of two goals stored; one goal of one of them is run again with another model, and slices of the
    other are patched: each step rewrites the partitions it names."""
    t = Tables(spark, sf)
    filled, open_, keys = _patch_frames(t)
    per_customer = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    of = per_customer.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = of.groupBy((F.col("c_nationkey") + 1).alias("region_id")).agg(F.sum("n").cast("double").alias("score"))
    counts = n.select("region_id", F.lit("ORD").alias("goal"), F.lit("status").alias("dimension"), "score")
    path = scratch_path(spark, "scenarios")
    for name, revenue in (("filled", filled), ("open", open_)):
        SC.write_scores(revenue.select("region_id", "goal", "dimension", "score").unionByName(counts), path, name)
    SC.write_scores(counts.withColumn("score", F.col("score") * 2), path, "open", ["ORD"])
    SC.patch_scores(spark, path, "filled", "open", keys)
    return SC.read_scores(spark, path)


def _reports(spark, sf, *diagnostics: str) -> str:
    """A run's reference points and some of its diagnostics, written twice as a rerun would."""
    path = scratch_path(spark, "reports")
    res = run_leaf_goals(store_for(spark, sf, ["MAR", "TR", "CS"]), M.PROXY_PARAMS, only=REFERENCE_GOALS)
    tables = {"reference_points": res.reference_points, **{k: res.diagnostics[k] for k in diagnostics}}
    for _ in range(2):
        SC.write_reports(spark, tables, path, "proxy")
    return path


@register("stored_reference_points", REFPOINTS_SQL.strip())
def q_stored_reference_points(spark, sf):
    return SC.read_report(spark, _reports(spark, sf), "reference_points", "proxy")


@register("stored_diagnostics", HAB_CONTRIB_SQL)
def q_stored_diagnostics(spark, sf):
    return SC.read_report(spark, _reports(spark, sf, "cs_hab_contributions"), "cs_hab_contributions", "proxy")


# ---------------------------------------------------------------- goals scheduled by what they read


def _mean_status(layers, scores, params) -> G.GoalResult:
    """A user's goal: the mean status of the goals it reads."""
    status = scores.where("dimension = 'status'").groupBy("region_id").agg(F.avg("score").alias("score"))
    return G.GoalResult(G.scores_frame(status, "USR", "status"), G.refpoint(layers.df.sparkSession, "USR", "mean of CW, SPP and AO"))


@register(
    "scheduled_goals",
    f"""WITH s AS (SELECT * FROM ({CW_SQL}) UNION ALL SELECT * FROM ({SPP_SQL}) UNION ALL SELECT * FROM ({AO_SQL})),
u AS (SELECT region_id, 'USR' AS goal, 'status' AS dimension, avg(score) AS score FROM s WHERE dimension = 'status' GROUP BY 1)
SELECT 'proxy' AS scenario, goal, dimension, region_id, round(score, 4) AS score FROM (SELECT region_id, goal, dimension, score FROM s UNION ALL SELECT * FROM u)""",
)
def q_scheduled_goals(spark, sf):
    reads = ("CW", "SPP", "AO")
    jobs = leaf_jobs() | {"USR": GoalJob("USR", _mean_status, reads=reads)}
    out = run_goals(store_for(spark, sf, reads), scratch_path(spark, "scheduled"), "proxy", M.PROXY_PARAMS, ["USR"], jobs)
    return out.withColumn("score", F.round("score", 4))
