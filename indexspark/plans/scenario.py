"""Scenario scoring (E1): run every goal model in calculation order, then composites, restriction and finalisation.

The goal table names each goal's model; a Python registry maps goal code -> job (no evaluation of text). Leaf goals
return lazy plans that are unioned into one scores frame; that frame is stored (Parquet in the session's shared
folder) before the composites so four composites do not re-run every leaf plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.layers import LayerStore
from . import composite as C
from . import goals as G
from . import metadata as M
from .liveco import GLOBAL_FIXES, liv_eco_pair
from .quality import scores_report

LeafJob = Callable[[LayerStore, DataFrame, Mapping], G.GoalResult]

LEAF_JOBS: dict[str, LeafJob] = {
    "FIS": lambda L, s, p: G.fis(L, p["status_year"]),
    "MAR": lambda L, s, p: G.mar(L, p["status_year"]),
    "AO": lambda L, s, p: G.ao(L, p["status_year"]),
    "NP": lambda L, s, p: G.np_goal(L, s, p["status_year"]),
    "CS": lambda L, s, p: G.cs(L),
    "CP": lambda L, s, p: G.cp(L),
    "TR": lambda L, s, p: G.tr(L, p["status_year"], p.get("pct_ref", 90)),
    "LIV": lambda L, s, p: _pair(L, p)["LIV"],
    "ECO": lambda L, s, p: _pair(L, p)["ECO"],
    "ICO": lambda L, s, p: G.ico(L),
    "LSP": lambda L, s, p: G.lsp(L, p["status_year"], p.get("ref_pct_cmpa", 30), p.get("ref_pct_cp", 30)),
    "CW": lambda L, s, p: G.cw(L),
    "HAB": lambda L, s, p: G.hab(L),
    "SPP": lambda L, s, p: G.spp(L),
}

COMPOSITES = ("FP", "LE", "SP", "BD")

def _pair(layers: LayerStore, p: Mapping) -> dict[str, G.GoalResult]:
    """LIV and ECO share one computation per store and parameters, which the store itself keeps."""
    args = (p["liv_workforcesize_year"], p["eco_rev_adj_min_year"], p.get("fixes"))
    for known, pair in layers.pairs:
        if known == args:
            return pair
    stop = {"fail_on_unmatched": True} if p.get("fail_on_unmatched") else {}
    layers.pairs.append((args, liv_eco_pair(layers, *args, **stop)))
    return layers.pairs[-1][1]


def empty_scores(spark) -> DataFrame:
    return spark.createDataFrame([], G.SCORES_SCHEMA)


@dataclass
class ScenarioResult:
    scores: DataFrame
    reference_points: DataFrame
    diagnostics: dict[str, DataFrame] = field(default_factory=dict)


def run_leaf_goals(layers: LayerStore, params: Mapping[str, Mapping] | None = None, only: set[str] | None = None) -> ScenarioResult:
    """Leaf goals in ``order_calculate`` order; a goal that reads scores (NP reads FIS) sees the scores so far."""
    spark = layers.df.sparkSession
    params = params or M.PROXY_PARAMS
    scores = empty_scores(spark)
    rps, diags = [], {}
    for _, _, _, goal, *_ in sorted(M.GOALS, key=lambda g: g[2]):
        if goal not in LEAF_JOBS or (only is not None and goal not in only):
            continue
        res = LEAF_JOBS[goal](layers, scores, params.get(goal, {}))
        scores = scores.unionByName(res.scores)
        rps.append(res.reference_points)
        diags.update(res.diagnostics)
    rp = rps[0]
    for r in rps[1:]:
        rp = rp.unionByName(r)
    return ScenarioResult(scores, rp, diags)


@dataclass
class ExtensionInputs:
    """Inputs of the reconstructed post-model steps (pressures, resilience, future, score, Index, global region)."""

    pressures_matrix: DataFrame  # goal, layer, weight and, where goals have elements, element
    pressure_categories: DataFrame  # layer, category, subcategory
    resilience_matrix: DataFrame  # goal, layer and, where goals have elements, element
    resilience_categories: DataFrame  # layer, category_type, weight
    layer_values: DataFrame  # region_id, layer, value
    areas: DataFrame  # region_id, area
    goals: DataFrame  # the goal table (roots and weights for the Index)
    element_weights: DataFrame | None = None  # goal, element, region_id, weight; elements count alike without it


def _round(df: DataFrame, digits: int | None) -> DataFrame:
    return df if digits is None else df.withColumn("score", F.round("score", digits))


def run_scenario(layers: LayerStore, params: Mapping[str, Mapping] | None = None, checkpoint: bool = True,
                 nullify_label: str = "Antarctica", leaf_digits: int | None = None,
                 extensions: ExtensionInputs | None = None, only: set[str] | None = None, patch: DataFrame | None = None,
                 patch_keys: DataFrame | None = None) -> ScenarioResult:
    """Leaf goals (all, or ``only`` some), composites, restriction, finalisation. Scores are rounded once, at the end;
    with ``leaf_digits`` leaf scores are published at so many decimals before the composites read them. ``patch`` and
    ``patch_keys`` are the scenario patch that the livelihoods composite applies.

    With ``extensions`` the reconstructed steps run in the published order: pressures and resilience per goal,
    likely future and score for every goal with a status, the composites over all four goal dimensions, the Index
    over the root goals and the area-weighted global region 0, each published at ``leaf_digits``.
    """
    from . import extensions as X

    leaf = run_leaf_goals(layers, params, only)
    scores = _round(leaf.scores, leaf_digits)
    if extensions is not None:
        goals = [g for g in LEAF_JOBS if only is None or g in only]
        e = extensions
        p = _round(X.pressures(goals, e.pressures_matrix, e.pressure_categories, e.layer_values,
                               element_weights=e.element_weights), leaf_digits)
        r = _round(X.resilience(goals, e.resilience_matrix, e.resilience_categories, e.layer_values,
                                element_weights=e.element_weights), leaf_digits)
        scores = scores.unionByName(G.scores_frame(p, F.col("goal"), F.col("dimension")))
        scores = scores.unionByName(G.scores_frame(r, F.col("goal"), F.col("dimension")))
        fs = _round(X.likely_future_and_score(scores), leaf_digits)
        scores = scores.unionByName(G.scores_frame(fs, F.col("goal"), F.col("dimension")))
    scores = stored(scores, "leaf-scores") if checkpoint else scores
    scores, fp_checks = C.fp(layers, scores)
    scores = C.le(layers, scores, patch, patch_keys)
    scores = C.sp(scores)
    scores = C.bd(scores)
    if extensions is not None:
        idx = _round(X.index_score(scores, extensions.goals), leaf_digits)
        scores = scores.unionByName(G.scores_frame(idx, F.col("goal"), F.col("dimension")))
        glob = _round(X.area_weighted_global(scores, extensions.areas), leaf_digits)
        scores = scores.unionByName(G.scores_frame(glob, F.col("goal"), F.col("dimension")))
    scores = C.pre_global(layers, scores, nullify_label=nullify_label)
    final = C.finalize(layers, scores)
    leaf.diagnostics["fp_checks"] = fp_checks
    leaf.diagnostics.update({f"quality_{k}": v for k, v in scores_report(final).items()})
    return ScenarioResult(final, leaf.reference_points, leaf.diagnostics)


# fixed values: model parameters of the global scenario's goal table
GLOBAL_PARAMS = {
    "FIS": {"status_year": 2011},
    "MAR": {"status_year": 2013},
    "AO": {"status_year": 2013},
    "NP": {"status_year": 2011},
    "TR": {"status_year": 2013, "pct_ref": 90},
    "LIV": {"liv_workforcesize_year": 2012, "eco_rev_adj_min_year": 2000, "fixes": GLOBAL_FIXES, "fail_on_unmatched": True},
    "ECO": {"liv_workforcesize_year": 2012, "eco_rev_adj_min_year": 2000, "fixes": GLOBAL_FIXES, "fail_on_unmatched": True},
    "LSP": {"status_year": 2014, "ref_pct_cmpa": 30, "ref_pct_cp": 30},
}


def score_csv_layers(spark, layer_dir: str, goals: set[str] | None = None, params: Mapping[str, Mapping] | None = None,
                     store_path: str | None = None, finalise: bool = False) -> ScenarioResult:
    """E1 on a directory of layer CSVs: catalog by rule, ingest into the long store (written once as Parquet
    partitioned by layer), then the leaf goals that have all their layers there (or ``goals``) and, with ``finalise``,
    composites, restriction and finalisation over them."""
    from ..sources.catalog import catalog_for_dir
    from ..sources.layers import ingest_catalog

    cat = catalog_for_dir(spark, layer_dir)
    if goals is None:
        present = {r["layer"] for r in cat.select("layer").collect()}  # metadata: one row per file
        goals = {g for g in LEAF_JOBS if present.issuperset(M.GOAL_LAYERS[g])}
    store = ingest_catalog(spark, cat, layer_dir).materialize(store_path)
    if finalise:
        return run_scenario(store, params or GLOBAL_PARAMS, only=goals)
    return run_leaf_goals(store, params or GLOBAL_PARAMS, only=goals)
