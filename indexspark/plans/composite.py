"""Composite goals (G3 FP, G10 LE, G13 SP, G17 BD), the pre-global restriction (G18) and finalisation.

Each composite returns the input scores plus its own rows. Inputs are long ``scores(region_id, goal, dimension,
score)`` frames, so each composite is a filter, a small pivot or grouped mean, and a union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import reshape as R
from ..sources.layers import LayerStore
from . import metadata as M
from .goals import scores_frame

NOT_PR = ("pressures", "resilience")


def fp(layers: LayerStore, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted mean of FIS and MAR (weights w_FIS and 1-w_FIS) per region and dimension; plus a check table."""
    w = layers.narrow("fp_wildcaught_weight", id_num="region_id", val_num="w_FIS")
    s = (
        scores.where(F.col("goal").isin("FIS", "MAR") & S.not_in_safe("dimension", NOT_PR))
        .join(w, "region_id", "left")
        .withColumn("w_MAR", 1 - F.col("w_FIS"))
        .withColumn("weight", F.when(F.col("goal") == "FIS", F.col("w_FIS")).otherwise(F.col("w_MAR")))
    )
    sd = F.col("dimension") == "score"
    has_w = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    no_w = lambda c: F.col(c).isNull() | (F.col(c) == 0)
    pos = F.col("score").isNotNull() & (F.col("score") > 0)
    checks = s.select(
        "region_id",
        "goal",
        F.when((F.col("goal") == "FIS") & F.col("score").isNull() & has_w("w_FIS") & sd, "weight but no score")
        .when((F.col("goal") == "MAR") & F.col("score").isNull() & has_w("w_MAR") & sd, "weight but no score")
        .when((F.col("goal") == "FIS") & pos & no_w("w_FIS") & sd & (F.col("region_id") != 0), "score but no weight")
        .when((F.col("goal") == "MAR") & pos & no_w("w_MAR") & sd & (F.col("region_id") != 0), "score but no weight")
        .alias("problem"),
    ).where(F.col("problem").isNotNull())
    out = s.groupBy("region_id", "dimension").agg(S.weighted_mean("score", "weight", na_rm=True).alias("score"))
    return scores.unionByName(scores_frame(out, "FP", F.col("dimension"))), checks


def _mean_of(scores: DataFrame, goals: Sequence[str], new_goal: str, dims: Sequence[str] | None = None) -> DataFrame:
    """Row mean of the listed goals per region and dimension (``rowMeans(na.rm=TRUE)`` after ``dcast``)."""
    s = scores.where(F.col("goal").isin(list(goals)))
    s = s.where(F.col("dimension").isin(list(dims))) if dims else s.where(S.not_in_safe("dimension", NOT_PR))
    wide = R.pivot(s, ["region_id", "dimension"], "goal", list(goals), "score")
    return scores_frame(wide.withColumn("score", S.row_mean(*goals)), new_goal, F.col("dimension"))


def le(layers: LayerStore, scores: DataFrame, patch: DataFrame | None = None, patch_keys: DataFrame | None = None) -> DataFrame:
    """LE = mean(ECO, LIV); optional scenario patch (S10) first; then LIV/ECO/LE set to NA for southern islands
    (georegion r2 = 999) and unpopulated regions (latest population missing or 0)."""
    if patch is not None:
        scores = scenario_patch(scores, patch, patch_keys)
    scores = scores.unionByName(_mean_of(scores, ["ECO", "LIV"], "LE", ["status", "trend", "score", "future"]))
    geo = layers.narrow("rgn_georegions", id_num="region_id", category="level", val_num="g")
    islands = geo.where((F.col("level") == "r2") & (F.col("g") == 999)).select("region_id")
    popn = layers.narrow("le_popn", id_num="region_id", year="year", val_num="count")
    latest = popn.groupBy("region_id").agg(F.max_by("count", "year").alias("count"))
    unpop = latest.where(F.col("count").isNull() | (F.col("count") == 0)).select("region_id")
    hit = islands.unionByName(unpop).distinct().withColumn("__hit", F.lit(True))
    scores = scores.join(hit, "region_id", "left")
    cond = F.col("goal").isin("LIV", "ECO", "LE") & S.not_in_safe("dimension", NOT_PR) & F.coalesce(F.col("__hit"), F.lit(False))
    return scores.withColumn("score", F.when(cond, None).otherwise(F.col("score"))).drop("__hit").select("region_id", "goal", "dimension", "score")


def scenario_patch(scores: DataFrame, other: DataFrame, keys: DataFrame) -> DataFrame:
    """Replace the ``(goal, dimension, region_id)`` slices listed in ``keys`` with the rows of ``other``."""
    k = keys.select("goal", "dimension", "region_id").distinct()
    kept = scores.join(k, ["goal", "dimension", "region_id"], "left_anti")
    return kept.unionByName(other.join(k, ["goal", "dimension", "region_id"], "left_semi").select(*scores.columns))


def sp(scores: DataFrame) -> DataFrame:
    """SP = mean(ICO, LSP) skipping NA, dimensions other than pressures/resilience."""
    return scores.unionByName(_mean_of(scores, ["ICO", "LSP"], "SP"))


def bd(scores: DataFrame) -> DataFrame:
    """BD = mean over HAB and SPP rows (NA skipped)."""
    s = scores.where(F.col("goal").isin("HAB", "SPP") & S.not_in_safe("dimension", NOT_PR))
    d = s.groupBy("region_id", "dimension").agg(F.avg("score").alias("score"))
    return scores.unionByName(scores_frame(d, "BD", F.col("dimension")))


def pre_global(layers: LayerStore, scores: DataFrame, region_labels: str = "rgn_global", nullify_label: str = "Antarctica") -> DataFrame:
    """Keep listed regions and the global region 0; the region labelled ``nullify_label`` gets NA scores."""
    rg = layers.narrow(region_labels, id_num="region_id", val_chr="label")
    listed = rg.groupBy(F.col("region_id").cast("int").alias("region_id")).agg(F.max(F.col("label") == nullify_label).alias("__null"))
    own = scores.where("region_id <> 0").join(listed, "region_id")
    glob = scores.where("region_id = 0").join(listed.where("region_id = 0").select("region_id", "__null"), "region_id", "left")
    score = F.when(F.coalesce("__null", F.lit(False)), None).otherwise(F.col("score")).alias("score")
    return own.unionByName(glob).select(*[score if c == "score" else F.col(c) for c in scores.columns])


def finalize(layers: LayerStore, scores: DataFrame, goals: Sequence[str] | None = None, region_labels: str = "rgn_global") -> DataFrame:
    """Complete grid region x dimension x (goals + Index) minus the two exclusions, full merge, round 2 dp
    half-even."""
    goal_codes = list(goals) if goals is not None else [g[3] for g in M.GOALS]
    rg = layers.narrow(region_labels, id_num="region_id").select(F.col("region_id").cast("int"))
    regions = rg.unionByName(rg.sparkSession.range(1).select(F.lit(0).cast("int").alias("region_id"))).distinct()
    grid = R.with_dimension(R.with_dimension(regions, "dimension", M.DIMENSIONS), "goal", [*goal_codes, "Index"])
    grid = grid.where(
        ~(F.col("dimension").isin("pressures", "resilience", "trend") & (F.col("region_id") == 0))
        & ~(F.col("dimension").isin("pressures", "resilience", "status", "trend") & (F.col("goal") == "Index"))
    )
    keys = ["goal", "dimension", "region_id"]
    merged = scores.select(*keys, "score").join(grid.select(*keys), on=keys, how="full")
    # half-even at 2 dp after removing floating noise below 1e-9, so exact decimal ties round as exact arithmetic would
    return merged.select("goal", "dimension", "region_id", S.r_round(F.round("score", 9), 2).alias("score"))
