"""Extensions (X1-X7): steps the scoring metadata declares but whose code is external to the scoring functions.

X1 georegional gap fill is called by LIV/ECO; X2-X7 turn goal status/trend into pressures, resilience, likely
future, goal score, the Index and the area-weighted global region. Formulas follow the published method (gamma,
beta, discount and default trend from the scenario configuration); they are clearly marked as reconstructions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import reshape as R
from ..sources.layers import LayerStore
from . import metadata as M

LEVELS = ("r2", "r1", "r0")


def georegions_wide(layers: LayerStore, layer: str = "rgn_georegions") -> DataFrame:
    """``rgn_id, r0, r1, r2`` from the long georegion layer (dcast ``rgn_id ~ level``)."""
    g = layers.narrow(layer, id_num="rgn_id", category="level", val_num="georgn_id").withColumn("georgn_id", F.col("georgn_id").cast("int"))
    return R.pivot(g, ["rgn_id"], "level", list(reversed(LEVELS)), "georgn_id")


def gapfill_georegions(
    data: DataFrame, georegions: DataFrame, fld_id: str, fld_value: str, fld_weight: str | None = None, r0_to_na: bool = True
) -> DataFrame:
    """Fill regions without a value from the (weighted) mean of their georegion, finest level first.

    Output: one row per region of ``georegions`` with ``score`` and provenance ``z_level`` (``'v'`` = own value,
    ``'r2'``/``'r1'``/``'r0'`` = filled at that level) and ``z_n`` (number of regions averaged). With ``r0_to_na`` a
    value that could only come from the global level stays NULL. Each level is one grouped aggregate joined back on
    the georegion id: no per-region loop.
    """
    d = data.select(F.col(fld_id).alias("rgn_id"), F.col(fld_value).alias("v"),
                    (F.col(fld_weight) if fld_weight else F.lit(1.0)).alias("w")).where(F.col("rgn_id").isNotNull())
    base = georegions.join(d, "rgn_id", "left")
    out = base
    for lvl in LEVELS:
        agg = (
            base.where(F.col("v").isNotNull())
            .groupBy(lvl)
            .agg(
                F.coalesce(S.weighted_mean("v", "w", na_rm=True), F.avg("v")).alias(f"m_{lvl}"),
                F.count(F.lit(1)).alias(f"n_{lvl}"),
            )
        )
        out = out.join(agg, lvl, "left")
    filled = F.coalesce(F.col("v"), F.col("m_r2"), F.col("m_r1"), F.lit(None) if r0_to_na else F.col("m_r0"))
    level = (
        F.when(F.col("v").isNotNull(), F.lit("v"))
        .when(F.col("m_r2").isNotNull(), F.lit("r2"))
        .when(F.col("m_r1").isNotNull(), F.lit("r1"))
        .when(F.col("m_r0").isNotNull() & F.lit(not r0_to_na), F.lit("r0"))
    )
    n = F.when(F.col("v").isNotNull(), F.lit(1)).when(F.col("m_r2").isNotNull(), F.col("n_r2")).when(F.col("m_r1").isNotNull(), F.col("n_r1"))
    return out.select("rgn_id", "r0", "r1", "r2", filled.alias("score"), level.alias("z_level"), n.alias("z_n"))


# ---------------------------------------------------------------- X2, X3: pressures and resilience


def _elements(matrix: DataFrame) -> DataFrame:
    """The matrix with its element column; goals without elements (and matrices without the column) have one, ``''``."""
    element = F.coalesce(F.col("element"), F.lit("")) if "element" in matrix.columns else F.lit("")
    return matrix.withColumn("element", element)


def _over_elements(parts: DataFrame, dimension: str, weights: DataFrame | None) -> DataFrame:
    """Goal values from element values. ``weights(goal, element, region_id, weight)`` says what an element contributes
    in a region: in a goal it names, elements without a weight there count nothing; elsewhere all count alike, as does
    what the matrix says of a goal without naming an element."""
    w = F.lit(1.0)
    if weights is not None:
        keys = ["goal", "element", "region_id"]
        weighted = weights.select("goal").distinct().withColumn("__weighted", F.lit(True))
        parts = parts.join(weights.groupBy(*keys).agg(F.sum("weight").alias("__w")), keys, "left").join(weighted, "goal", "left")
        w = F.when(F.col("__weighted") & (F.col("element") != ""), F.coalesce("__w", F.lit(0.0))).otherwise(1.0)
    g = parts.groupBy("goal", "region_id").agg(S.weighted_mean("value", w).alias("value"))
    return g.select("region_id", "goal", F.lit(dimension).alias("dimension"), (F.col("value") * 100).alias("score"))


def pressures(
    scores_goals: Sequence[str],
    matrix_long: DataFrame,
    categories: DataFrame,
    layer_values: DataFrame,
    gamma: float = M.PRESSURES_GAMMA,
    element_weights: DataFrame | None = None,
) -> DataFrame:
    """X2 (reconstruction): goal pressures per region on 0-100.

    ``matrix_long(goal[, element], layer, weight 1-3)``; ``categories(layer, category 'ecological'|'social',
    subcategory)``; ``layer_values(region_id, layer, value 0-1)``. Per goal element, ecological: per subcategory
    ``p_k = min(1, sum(w*s)/3)`` then a weighted mean of ``p_k`` by the subcategory's max weight; social: mean of social
    layer values weighted by matrix weight. ``p = gamma*E + (1-gamma)*S`` (whichever exists when only one does). A
    goal's pressure is the mean of its elements, weighted by ``element_weights`` where it names the goal.
    """
    keys = ["goal", "element", "region_id"]
    m = _elements(matrix_long.where(F.col("goal").isin(list(scores_goals)))).join(categories, "layer", "inner")
    j = m.join(layer_values, "layer", "inner")
    eco = (
        j.where(F.col("category") == "ecological")
        .groupBy(*keys, "subcategory")
        .agg(S.clamp(F.sum(F.col("weight") * F.col("value")) / 3.0, hi=1.0).alias("p_k"), F.max("weight").alias("w_k"))
        .groupBy(*keys)
        .agg(S.weighted_mean("p_k", "w_k").alias("p_e"))
    )
    soc = j.where(F.col("category") == "social").groupBy(*keys).agg(S.weighted_mean("value", "weight").alias("p_s"))
    p = eco.join(soc, keys, "full")
    combined = (
        F.when(F.col("p_e").isNotNull() & F.col("p_s").isNotNull(), F.lit(gamma) * F.col("p_e") + F.lit(1 - gamma) * F.col("p_s"))
        .otherwise(F.coalesce("p_e", "p_s"))
    )
    return _over_elements(p.select(*keys, combined.alias("value")), "pressures", element_weights)


def resilience(
    scores_goals: Sequence[str],
    matrix_long: DataFrame,
    categories: DataFrame,
    layer_values: DataFrame,
    gamma: float = M.RESILIENCE_GAMMA,
    element_weights: DataFrame | None = None,
) -> DataFrame:
    """X3 (reconstruction): goal resilience per region on 0-100.

    ``matrix_long(goal[, element], layer)``; ``categories(layer, category_type 'ecological'|'regulatory'|'social',
    weight)``. Per goal element, ecological integrity ``Y_E`` and regulations ``G`` are weighted means of their layers,
    social ``Y_S`` likewise; ``r = gamma*(Y_E+G)/2 + (1-gamma)*Y_S`` with missing parts dropped. Elements are averaged
    as in ``pressures``.
    """
    keys = ["goal", "element", "region_id"]
    m = _elements(matrix_long.where(F.col("goal").isin(list(scores_goals)))).select("goal", "element", "layer").distinct()
    j = m.join(categories, "layer", "inner").join(layer_values, "layer", "inner")
    part = j.groupBy(*keys, "category_type").agg(S.weighted_mean("value", "weight").alias("v"))
    wide = R.pivot(part, keys, "category_type", ["ecological", "regulatory", "social"], "v")
    eco = S.row_mean("ecological", "regulatory")
    r = (
        F.when(eco.isNotNull() & F.col("social").isNotNull(), F.lit(gamma) * eco + F.lit(1 - gamma) * F.col("social"))
        .otherwise(F.coalesce(eco, F.col("social")))
    )
    return _over_elements(wide.select(*keys, r.alias("value")), "resilience", element_weights)


# ---------------------------------------------------------------- X4-X7


def likely_future_and_score(scores: DataFrame, beta: float = M.GOAL_BETA, discount: float = M.GOAL_DISCOUNT,
                            default_trend: float = M.DEFAULT_TREND) -> DataFrame:
    """``future = clamp((1 + beta*T + (1-beta)*(r-p)) * x / discount, 0, 100)`` and ``score = mean(x, future)``.

    Input: long scores with status, trend, pressures, resilience; output: the future and score rows.
    """
    wide = R.pivot(
        scores.where(F.col("dimension").isin("status", "trend", "pressures", "resilience")),
        ["region_id", "goal"], "dimension", ["status", "trend", "pressures", "resilience"], "score",
    )
    t = F.coalesce(F.col("trend"), F.lit(default_trend))
    rp = F.coalesce(F.col("resilience") / 100, F.lit(0.0)) - F.coalesce(F.col("pressures") / 100, F.lit(0.0))
    future = S.clamp((1 + F.lit(beta) * t + F.lit(1 - beta) * rp) * F.col("status") / F.lit(discount), 0.0, 100.0)
    f = wide.select("region_id", "goal", future.alias("future"), F.col("status"))
    fut = f.select("region_id", "goal", F.lit("future").alias("dimension"), F.col("future").alias("score"))
    sc = f.select("region_id", "goal", F.lit("score").alias("dimension"), S.row_mean("status", "future").alias("score"))
    return fut.unionByName(sc)


def index_score(scores: DataFrame, goals: DataFrame, dimensions: Sequence[str] = ("score", "future")) -> DataFrame:
    """Index = weighted mean of the *root* goals' scores (weights from the goal table), per region and dimension."""
    roots = goals.where(F.col("parent").isNull()).select("goal", "weight")
    s = scores.where(F.col("dimension").isin(list(dimensions))).join(roots, "goal", "inner")
    return s.groupBy("region_id", "dimension").agg(S.weighted_mean("score", "weight").alias("score")).withColumn("goal", F.lit("Index"))


def area_weighted_global(scores: DataFrame, areas: DataFrame, dimensions: Sequence[str] = ("status", "future", "score")) -> DataFrame:
    """Region 0 = area-weighted mean over regions, per goal and dimension (``areas(region_id, area)``)."""
    s = scores.where((F.col("region_id") != 0) & F.col("dimension").isin(list(dimensions))).join(areas, "region_id", "inner")
    return s.groupBy("goal", "dimension").agg(S.weighted_mean("score", "area").alias("score")).withColumn("region_id", F.lit(0))
