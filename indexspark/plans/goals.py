"""Leaf goal models (G1, G2, G4-G9, G11, G12, G14-G16) as DataFrame plans over a ``LayerStore``.

Each job returns a ``GoalResult``: ``scores(region_id, goal, dimension, score)``, a reference-point frame
``(goal, method, reference_point)`` and named diagnostic frames. Nothing is collected: results are lazy plans that the
caller unions and writes in one action.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import joins as J
from ..operators import reshape as R
from ..operators import windows as W
from ..operators.filters import double_membership_exclude
from ..sources.layers import LayerStore

SCORES_SCHEMA = "region_id int, goal string, dimension string, score double"
REFPOINT_SCHEMA = "goal string, method string, reference_point string"


@dataclass
class GoalResult:
    scores: DataFrame
    reference_points: DataFrame
    diagnostics: dict[str, DataFrame] = field(default_factory=dict)


def scores_frame(df: DataFrame, goal: str | Column, dimension: str | Column, region: str = "region_id", score: str = "score") -> DataFrame:
    g = F.lit(goal) if isinstance(goal, str) else goal
    d = F.lit(dimension) if isinstance(dimension, str) else dimension
    return df.select(
        F.col(region).cast("int").alias("region_id"), g.alias("goal"), d.alias("dimension"), S.nan_to_null(F.col(score).cast("double")).alias("score")
    )


def refpoint(spark: SparkSession, goal: str, method: str, value: str | None = None) -> DataFrame:
    """One reference-point row (``goal, method, reference_point``)."""
    return spark.createDataFrame([(goal, method, value)], REFPOINT_SCHEMA)


def _spark(layers: LayerStore) -> SparkSession:
    return layers.df.sparkSession


# ---------------------------------------------------------------- G14 CW


def cw(layers: LayerStore) -> GoalResult:
    lyrs = ["po_pathogens", "po_nutrients_3nm", "po_chemicals_3nm", "po_trash",
            "cw_pesticide_trend", "cw_fertilizer_trend", "cw_coastalpopn_trend", "cw_pathogen_trend"]
    d = layers.select_many(lyrs).select(F.col("id_num").alias("region_id"), "layer", F.col("val_num").alias("value"))
    status = (
        d.where(F.col("layer").rlike("po_"))
        .groupBy("region_id")
        .agg((S.geo_mean(1 - F.col("value")) * 100).alias("score"))
    )
    trend = d.where(F.col("layer").rlike("_trend")).groupBy("region_id").agg(F.avg(-F.col("value")).alias("score"))
    scores = scores_frame(status, "CW", "status").unionByName(scores_frame(trend, "CW", "trend"))
    rp = refpoint(_spark(layers), "CW", "spatial: pressures scaled from 0-1 at raster level")
    return GoalResult(scores, rp)


# ---------------------------------------------------------------- G16 SPP


def spp(layers: LayerStore) -> GoalResult:
    d = layers.alias({"spp_status": "status", "spp_trend": "trend"})
    d = d.select(
        F.col("id_num").alias("region_id"),
        F.col("layer").alias("dimension"),
        F.when(F.col("layer") == "status", F.col("val_num") * 100).otherwise(F.col("val_num")).alias("score"),
    )
    rp = refpoint(_spark(layers), "SPP", "Average of IUCN risk categories, scaled to historic extinction")
    return GoalResult(scores_frame(d, "SPP", F.col("dimension")), rp)


# ---------------------------------------------------------------- habitat goals: G15 HAB, G6 CS, G7 CP


def _habitat_layers(layers: LayerStore):
    extent = layers.narrow("hab_extent", id_num="rgn_id", category="habitat", val_num="km2")
    health = layers.narrow("hab_health", id_num="rgn_id", category="habitat", val_num="health")
    trend = layers.narrow("hab_trend", id_num="rgn_id", category="habitat", val_num="trend")
    return extent, health, trend


# fixed values: habitats scored by HAB
HAB_HABITATS = ["coral", "mangrove", "saltmarsh", "seaice_edge", "seagrass", "soft_bottom"]


def hab(layers: LayerStore) -> GoalResult:
    extent, health, trend = _habitat_layers(layers)
    d = J.full_join_chain([health, trend, extent.withColumnRenamed("km2", "extent")], ["rgn_id", "habitat"])
    d = d.where(S.isin_safe("habitat", HAB_HABITATS))
    d = d.withColumn("w", F.when(F.col("extent").isNotNull() & (F.col("extent") > 0), F.lit(1.0))).where(F.col("w").isNotNull())
    status = d.where(F.col("health").isNotNull()).groupBy("rgn_id").agg(
        (S.clamp(S.safe_div(F.sum("health"), F.sum("w")), hi=1.0) * 100).alias("score")
    )
    tr = d.where(F.col("trend").isNotNull()).groupBy("rgn_id").agg(S.safe_div(F.sum("trend"), F.sum("w")).alias("score"))
    scores = scores_frame(status, "HAB", "status", "rgn_id").unionByName(scores_frame(tr, "HAB", "trend", "rgn_id"))
    warn = d.agg(
        F.count_if(F.col("trend").isNull()).alias("n_extent_without_trend"),
        F.count_if(F.col("health").isNull()).alias("n_extent_without_health"),
    )
    rp = refpoint(_spark(layers), "HAB", "Health/condition variable based on current vs. historic extent", "varies for each region/habitat")
    return GoalResult(scores, rp, {"hab_missing": warn})


def _ranked_habitat_scores(d: DataFrame, goal: str, ranks: Mapping[str, float]) -> tuple[DataFrame, DataFrame]:
    rank_map = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    d = d.where(S.isin_safe("habitat", list(ranks))).withColumns(
        {"rank": F.element_at(rank_map, F.col("habitat")).cast("double"), "extent": F.nullif(F.col("km2"), F.lit(0.0))}
    )
    contrib = (
        d.withColumn("weighted_cont", F.col("rank") * F.col("extent"))
        .where(F.col("weighted_cont").isNotNull())
        .select("rgn_id", "habitat", S.r_round(W.share_of_total("weighted_cont", "rgn_id"), 3).alias("prop_score"))
    )
    ok = F.col("rank").isNotNull() & F.col("extent").isNotNull()
    status = d.where(ok & F.col("health").isNotNull()).groupBy("rgn_id").agg(
        (S.clamp(S.safe_div(S.sum0(F.col("rank") * F.col("health") * F.col("extent")), S.sum0(F.col("extent") * F.col("rank"))), hi=1.0) * 100).alias("score")
    )
    trend = d.where(ok & F.col("trend").isNotNull()).groupBy("rgn_id").agg(
        S.safe_div(S.sum0(F.col("rank") * F.col("trend") * F.col("extent")), S.sum0(F.col("extent") * F.col("rank"))).alias("score")
    )
    scores = scores_frame(status, goal, "status", "rgn_id").unionByName(scores_frame(trend, goal, "trend", "rgn_id"))
    return scores, contrib


# fixed values: carbon storage ranks
CS_RANKS = {"mangrove": 139.0, "saltmarsh": 210.0, "seagrass": 83.0}
# fixed values: coastal protection ranks
CP_RANKS = {"coral": 4.0, "mangrove": 4.0, "saltmarsh": 3.0, "seagrass": 1.0, "seaice_shoreline": 4.0}


def cs(layers: LayerStore) -> GoalResult:
    extent, health, trend = _habitat_layers(layers)
    d = J.full_join_chain([extent, health, trend], ["rgn_id", "habitat"])
    scores, contrib = _ranked_habitat_scores(d, "CS", CS_RANKS)
    rp = refpoint(_spark(layers), "CS", "Health/condition variable based on current vs. historic extent", "varies for each region/habitat")
    return GoalResult(scores, rp, {"cs_hab_contributions": contrib})


def protected_extent(extent: DataFrame) -> DataFrame:
    """Extents as coastal protection counts them: mangroves are those inland and offshore, the plain rows go."""
    parts = ["mangrove_inland1km", "mangrove_offshore"]
    mangrove = (
        extent.where(F.col("habitat").isin(parts))
        .groupBy("rgn_id")
        .agg(S.sum0("km2").alias("km2"))
        .withColumn("habitat", F.lit("mangrove"))
    )
    return extent.where(S.not_in_safe("habitat", ["mangrove", *parts])).unionByName(mangrove)


def cp(layers: LayerStore) -> GoalResult:
    extent, health, trend = _habitat_layers(layers)
    extent = protected_extent(extent)
    d = J.full_join_chain([extent, health, trend], ["rgn_id", "habitat"])
    scores, contrib = _ranked_habitat_scores(d, "CP", CP_RANKS)
    rp = refpoint(_spark(layers), "CP", "Health/condition variable based on current vs. historic extent", "varies for each region/habitat")
    return GoalResult(scores, rp, {"cp_hab_contributions": contrib})


# ---------------------------------------------------------------- G4 AO


def ao(layers: LayerStore, status_year: int, sustainability: float = 1.0, bridge: DataFrame | None = None) -> GoalResult:
    data = layers.by_target("AO", bridge) if bridge is not None else layers.select_many(["ao_access", "ao_need"])
    year_min = F.greatest(data.agg(F.min("year")).scalar(), F.lit(status_year - 10))
    r = data.where(F.col("layer") == "ao_access").select(F.col("id_num").alias("region_id"), F.col("val_num").alias("access")).na.drop()
    ry = (
        data.where(F.col("layer") == "ao_need")
        .select(F.col("id_num").alias("region_id"), "year", F.col("val_num").alias("need"))
        .join(r, "region_id", "left")
        .withColumn("Du", (1 - F.col("need")) * (1 - F.col("access")))
        .withColumn("statusData", (1 - F.col("Du")) * F.lit(sustainability))
    )
    status = ry.where(F.col("year") == status_year).select("region_id", (F.col("statusData") * 100).alias("score"))
    recent = ry.where((F.col("year") >= year_min) & F.col("statusData").isNotNull())
    recent = recent.withColumn("__top", W.top_n_ties("year", "region_id", 5)).where("__top")
    trend = recent.groupBy("region_id").agg(S.trend_slope("statusData", "year").alias("score"))
    scores = scores_frame(status, "AO", "status").unionByName(scores_frame(trend, "AO", "trend"))
    return GoalResult(scores, refpoint(_spark(layers), "AO", "??"))


# ---------------------------------------------------------------- G11 ICO

# fixed values: IUCN risk weights and population-trend scores
ICO_RISK = [("LC", 1.0), ("NT", 0.8), ("VU", 0.6), ("EN", 0.4), ("CR", 0.2), ("EX", 0.0)]
ICO_TREND = [("decreasing", -0.5), ("stable", 0.0), ("increasing", 0.5)]


def ico(layers: LayerStore) -> GoalResult:
    spark = _spark(layers)
    rk = layers.select_many(["ico_spp_extinction_status", "ico_spp_popn_trend"]).select(
        F.col("id_num").alias("region_id"), F.col("category").alias("sciname"), F.col("val_chr").alias("iucn_cat"), "layer"
    )

    def two_stage(layer: str, lookup: DataFrame, scale: float) -> DataFrame:
        spp_mean = (
            rk.where(F.col("layer") == layer)
            .join(lookup, "iucn_cat", "left")
            .groupBy("region_id", "sciname")
            .agg((F.avg("w") * scale).alias("spp_mean"))
        )
        return spp_mean.groupBy("region_id").agg(F.avg("spp_mean").alias("score"))

    status = two_stage("ico_spp_extinction_status", J.lookup_table(spark, ICO_RISK, "iucn_cat string, w double"), 100.0)
    trend = two_stage("ico_spp_popn_trend", J.lookup_table(spark, ICO_TREND, "iucn_cat string, w double"), 1.0)
    scores = scores_frame(status, "ICO", "status").unionByName(scores_frame(trend, "ICO", "trend"))
    return GoalResult(scores, refpoint(spark, "ICO", "scaled IUCN risk categories"))


# ---------------------------------------------------------------- G12 LSP


def lsp(layers: LayerStore, status_year: int, ref_pct_cmpa: float = 30, ref_pct_cp: float = 30) -> GoalResult:
    r = R.pivot(
        layers.select_many(["rgn_area_inland1km", "rgn_area_offshore3nm"]).select(F.col("id_num").alias("region_id"), "layer", "val_num"),
        ["region_id"], "layer", ["rgn_area_inland1km", "rgn_area_offshore3nm"], "val_num",
    ).withColumnsRenamed({"rgn_area_inland1km": "area_inland1km", "rgn_area_offshore3nm": "area_offshore3nm"})
    ry = R.pivot(
        layers.select_many(["lsp_prot_area_offshore3nm", "lsp_prot_area_inland1km"]).select(F.col("id_num").alias("region_id"), "year", "layer", "val_num"),
        ["region_id", "year"], "layer", ["lsp_prot_area_offshore3nm", "lsp_prot_area_inland1km"], "val_num",
    ).withColumnsRenamed({"lsp_prot_area_offshore3nm": "cmpa", "lsp_prot_area_inland1km": "cp"})
    yrs = R.complete_series(ry, ["region_id"], "year").withColumns(
        {"cp": F.coalesce("cp", F.lit(0.0)), "cmpa": F.coalesce("cmpa", F.lit(0.0))}
    )
    yrs = yrs.withColumns(
        {"cp_cumsum": W.cumsum("cp", "region_id", "year"), "cmpa_cumsum": W.cumsum("cmpa", "region_id", "year")}
    ).withColumn("pa_cumsum", F.col("cp_cumsum") + F.col("cmpa_cumsum"))
    yrs = yrs.join(r, "region_id", "full")
    pct_cp = S.clamp(S.safe_div("cp_cumsum", "area_inland1km") * 100, hi=100.0)
    pct_cmpa = S.clamp(S.safe_div("cmpa_cumsum", "area_offshore3nm") * 100, hi=100.0)
    yrs = yrs.withColumns({"pct_cp": pct_cp, "pct_cmpa": pct_cmpa}).withColumn(
        "prop_protected",
        (S.clamp(F.col("pct_cp") / ref_pct_cp, hi=1.0) + S.clamp(F.col("pct_cmpa") / ref_pct_cmpa, hi=1.0)) / 2,
    ).where(F.col("prop_protected").isNotNull())
    status = yrs.where(F.col("year") == status_year).select("region_id", (F.col("prop_protected") * 100).alias("score"))
    trend = (
        yrs.where(F.col("year").between(status_year - 4, status_year))
        .groupBy("region_id")
        .agg(S.clamp(S.trend_slope("prop_protected", "year"), 0.0, 1.0).alias("score"))
    )
    scores = scores_frame(status, "LSP", "status").unionByName(scores_frame(trend, "LSP", "trend"))
    rp = refpoint(_spark(layers), "LSP", f"{ref_pct_cmpa:g}% marine protected area; {ref_pct_cp:g}% coastal protected area",
                  "varies by area of region's eez and 1 km inland")
    return GoalResult(scores, rp)


# ---------------------------------------------------------------- G2 MAR


def mar(layers: LayerStore, status_year: int) -> GoalResult:
    tonnes = layers.narrow("mar_harvest_tonnes", id_num="rgn_id", category="species_code", year="year", val_num="tonnes")
    species = layers.narrow("mar_harvest_species", category="species_code", val_chr="species")
    sust = layers.narrow("mar_sustainability_score", id_num="rgn_id", category="species_code", val_num="sust_coeff")
    popn = layers.narrow("mar_coastalpopn_inland25mi", id_num="rgn_id", year="year", val_num="popsum")
    rky = tonnes.join(species, "species_code", "left").join(sust, ["rgn_id", "species_code"], "left")
    series = ["rgn_id", "species", "species_code", "sust_coeff"]
    rky = _complete_null_safe(rky, series, "year")
    m = rky.withColumn("sm_tonnes", W.rolling_mean_centred("tonnes", series, "year", 4)).withColumn(
        "sust_tonnes", F.col("sust_coeff") * F.col("sm_tonnes")
    )
    ry = (
        m.groupBy("rgn_id", "year")
        .agg(S.sum0("sust_tonnes").alias("sust_tonnes_sum"))
        .join(popn, ["rgn_id", "year"], "left")
        .withColumn("mar_pop", S.safe_div("sust_tonnes_sum", "popsum"))
    )
    base = ry.where(F.col("year") <= status_year)
    ref_df = base.agg(S.quantile("mar_pop", 0.95).alias("ref"))
    ref = ref_df.scalar()
    holder = (
        base.withColumn("ref", ref)
        .where(F.col("mar_pop") >= F.col("ref"))
        # first row of a stable sort by mar_pop over rows ordered by (rgn_id, year): ties break by region, then year
        .agg(F.min_by("rgn_id", F.struct("mar_pop", "rgn_id", "year")).alias("rgn_id"), F.first("ref").alias("ref"))
    )
    ry = ry.withColumn("status", S.clamp(S.safe_div("mar_pop", ref), hi=1.0))
    status = ry.where(F.col("year") == status_year).select("rgn_id", S.r_round(F.col("status") * 100, 2).alias("score"))
    trend = (
        ry.where(F.col("year").between(status_year - 4, status_year))
        .groupBy("rgn_id")
        .agg(S.r_round(S.clamp(S.trend_slope("status", "year"), -1.0, 1.0), 2).alias("score"))
    )
    scores = scores_frame(status, "MAR", "status", "rgn_id").unionByName(scores_frame(trend, "MAR", "trend", "rgn_id"))
    rp = holder.select(
        F.lit("MAR").alias("goal"), F.lit("spatial 95th quantile").alias("method"),
        F.format_string("region id: %s value: %s", F.col("rgn_id").cast("string"), F.round("ref", 6).cast("string")).alias("reference_point"),
    )
    return GoalResult(scores, rp, {"mar_ref": holder})


def _complete_null_safe(df: DataFrame, keys: Sequence[str], over: str) -> DataFrame:
    """Spread/gather completion where series keys may be NULL (dcast groups NA keys together)."""
    grid = R.with_dimension(df.select(*keys).distinct(), over, R.present_values(df, over))
    return J.join_null_safe(grid, df, [*keys, over], how="left")


# ---------------------------------------------------------------- G8 TR


def tr(layers: LayerStore, status_year: int, pct_ref: float = 90, region_labels: str = "rgn_global", unpopulated_check: bool = True) -> GoalResult:
    spark = _spark(layers)
    names = layers.narrow(region_labels, id_num="rgn_id", val_chr="rgn_name")
    yl = {
        "tr_jobs_tourism": "Ed", "tr_jobs_pct_tourism": "Ep", "tr_unemployment": "U", "tr_jobs_total": "L",
    }
    frames = [layers.narrow(k, id_num="rgn_id", year="year", val_num=v) for k, v in yl.items()]
    d = J.full_join_chain(frames, ["rgn_id", "year"])
    d = d.join(layers.narrow("tr_sustainability", id_num="rgn_id", val_num="S_score"), "rgn_id", "full").join(names, "rgn_id", "full")
    d = d.where(F.col("year") <= status_year)
    E = F.when(F.col("Ep").isNull(), S.safe_div("Ed", F.col("L") - F.col("L") * F.col("U"))).otherwise(F.col("Ep"))
    model = d.withColumns({"E": E, "S": (F.col("S_score") - 1) / (7 - 1)}).withColumn("Xtr", F.col("E") * F.col("S"))
    model = model.where((F.col("year") <= status_year) & (F.col("year") > status_year - 5))
    tw = layers.narrow("tr_travelwarnings", id_chr="rgn_name", val_num="multiplier").join(names, "rgn_name", "left").where(F.col("rgn_id").isNotNull())
    model = model.join(tw.select("rgn_id", "multiplier"), "rgn_id", "left").withColumn(
        "Xtr", F.when(F.col("multiplier").isNotNull(), F.col("multiplier") * F.col("Xtr")).otherwise(F.col("Xtr"))
    )
    q = model.groupBy("year").agg(S.quantile("Xtr", pct_ref / 100).alias("Xtr_q"))
    model = model.select("rgn_id", "rgn_name", "year", "Xtr").join(q, "year", "left").withColumn(
        "Xtr_rq", S.clamp(S.safe_div("Xtr", "Xtr_q"), hi=1.0)
    )
    rp = q.where(F.col("year") == status_year).select(
        F.lit("TR").alias("goal"), F.lit(f"spatial: {pct_ref:g}th quantile").alias("method"),
        F.round("Xtr_q", 6).cast("string").alias("reference_point"),
    )
    trend = model.where(F.col("Xtr_rq").isNotNull()).groupBy("rgn_id").agg(S.clamp(S.trend_slope("Xtr_rq", "year"), -1.0, 1.0).alias("score"))
    status = model.groupBy("rgn_id").agg((S.latest("Xtr_rq", "year") * 100).alias("score"))
    sc = scores_frame(status, "TR", "status", "rgn_id").unionByName(scores_frame(trend, "TR", "trend", "rgn_id"))
    if unpopulated_check:
        popn = layers.narrow("le_popn", id_num="rgn_id", year="year", val_num="count")
        unpop = popn.where(F.col("count") == 0).select(F.col("rgn_id").alias("region_id")).distinct().withColumn("__u", F.lit(True))
        sc = sc.join(unpop, "region_id", "left").withColumn("score", F.when(F.col("__u"), None).otherwise(F.col("score"))).drop("__u")
    return GoalResult(sc, rp, {"tr_model": model})


# ---------------------------------------------------------------- G1 FIS

# fixed values: taxon penalty by first digit of the taxon key, and the buffered-score parameters
FIS_PENALTY = [(1, 0.01), (2, 0.25), (3, 0.5), (4, 0.8), (5, 0.9), (6, 1.0)]
FIS_SCORE = dict(alpha=0.5, beta=0.25, lower=0.95, upper=1.05)


def fis(layers: LayerStore, status_year: int) -> GoalResult:
    spark = _spark(layers)
    c = layers.narrow("fis_meancatch", id_chr="fao_saup_id", category="taxon_name_key", year="year", val_num="catch")
    c = R.split_columns(c, "fao_saup_id", ["fao_id", "saup_id"], "_")
    c = R.split_columns(c, "taxon_name_key", ["TaxonName", "TaxonKey"], "_")
    c = c.withColumns(
        {"fao_id": F.col("fao_id").try_cast("double"), "saup_id": F.col("saup_id").try_cast("double"), "TaxonKey": F.col("TaxonKey").try_cast("double")}
    ).withColumn("stock_id", F.concat_ws("_", "TaxonName", S.format_g("fao_id")))
    b = layers.narrow("fis_b_bmsy", id_num="fao_id", category="TaxonName", year="year", val_num="bmsy").withColumn(
        "fao_id", F.col("fao_id").cast("double")
    ).withColumn("stock_id", F.concat_ws("_", "TaxonName", S.format_g("fao_id")))
    a = layers.narrow("fis_proparea_saup2rgn", id_num="saup_id", category="rgn_id", val_num="prop_area").withColumns(
        {"saup_id": F.col("saup_id").cast("double"), "rgn_id": F.col("rgn_id").try_cast("int")}
    )
    score_args = FIS_SCORE
    assessed = (
        b.join(c, ["stock_id", "year", "TaxonName", "fao_id"], "inner")
        .where(F.col("TaxonKey") >= 600000)
        .withColumn("penalty", F.lit(1.0))
        .withColumn("score", S.piecewise_score(F.col("bmsy") * F.col("penalty"), **score_args))
    )
    unassessed = double_membership_exclude(c, assessed, [("year", "year"), ("stock_id", "stock_id")])
    b_summary = b.groupBy("fao_id", "year").agg(S.quantile("bmsy", 0.5).alias("Medianb_bmsy"))
    unassessed = unassessed.join(b_summary, ["fao_id", "year"], "left").withColumn(
        "TaxonPenaltyCode", F.substring(S.format_g("TaxonKey"), 1, 1).try_cast("double")
    )
    pen = J.lookup_table(spark, [(float(k), v) for k, v in FIS_PENALTY], "TaxonPenaltyCode double, penalty double")
    unassessed = unassessed.join(pen, "TaxonPenaltyCode", "left").where(F.col("penalty").isNotNull())
    unassessed = unassessed.withColumn("score", S.piecewise_score(F.col("Medianb_bmsy") * F.col("penalty"), **score_args))
    cols = ["TaxonName", "TaxonKey", "year", "fao_id", "saup_id", "catch", "score"]
    all_scores = assessed.select(*cols).unionByName(unassessed.select(*cols))
    w = Window.partitionBy("year", "saup_id")
    sum_catch = F.when(F.count("catch").over(w) == F.count(F.lit(1)).over(w), F.sum("catch").over(w))
    all_scores = all_scores.withColumn("wprop", S.safe_div("catch", sum_catch))
    geo = all_scores.groupBy("saup_id", "year").agg(S.geo_wmean("score", "wprop").alias("status_saup"))
    status_data = (
        geo.join(a, "saup_id", "inner")
        .groupBy("rgn_id", "year")
        .agg(S.sum_strict(F.col("status_saup") * F.col("prop_area")).alias("Status"))
    )
    status = status_data.where(F.col("year") == status_year).select("rgn_id", S.r_round(F.col("Status") * 100, 0).alias("score"))
    trend = status_data.groupBy("rgn_id").agg(S.r_round(S.trend_slope("Status", "year"), 2).alias("score"))
    scores = scores_frame(status, "FIS", "status", "rgn_id").unionByName(scores_frame(trend, "FIS", "trend", "rgn_id"))
    return GoalResult(scores, refpoint(spark, "FIS", "b/bmsy: modeled"), {"fis_status_data": status_data})


# ---------------------------------------------------------------- G5 NP

NP_DUAL = ["shells", "ornamentals", "sponges"]


def np_goal(layers: LayerStore, scores: DataFrame, status_year: int, region_labels: str = "rgn_labels") -> GoalResult:
    spark = _spark(layers)
    fis_status = scores.where((F.col("goal") == "FIS") & (F.col("dimension") == "status")).select(
        F.col("region_id").alias("rgn_id"), "score"
    )
    h_t = layers.narrow("np_harvest_tonnes", id_num="rgn_id", category="product", year="year", val_num="tonnes")
    h_r = layers.narrow("np_harvest_tonnes_relative", id_num="rgn_id", category="product", year="year", val_num="tonnes_rel")
    h_w = layers.narrow("np_harvest_product_weight", id_num="rgn_id", category="product", val_num="prod_weight")
    rgns = layers.narrow(region_labels, id_num="rgn_id", val_chr="rgn_name")
    harvest = h_t.join(h_r, ["rgn_id", "product", "year"], "full").join(h_w, ["rgn_id", "product"], "left").join(rgns, "rgn_id", "left")
    hab_extent = layers.narrow("hab_extent", id_num="rgn_id", category="habitat", val_num="km2")
    coral = hab_extent.where((F.col("habitat") == "coral") & (F.col("km2") > 0)).select("rgn_id", "km2")
    rocky = hab_extent.where((F.col("habitat") == "rocky_reef") & (F.col("km2") > 0)).select("rgn_id", "km2")
    single = harvest.where(F.col("product") == "corals").join(coral, "rgn_id", "left").unionByName(
        harvest.where(F.col("product") == "seaweeds").join(rocky, "rgn_id", "left")
    )
    dual = (
        harvest.where(F.col("product").isin(NP_DUAL))
        .join(coral.withColumnRenamed("km2", "coral_km2"), "rgn_id", "left")
        .join(rocky.withColumnRenamed("km2", "rocky_km2"), "rgn_id", "left")
        .withColumn("km2", S.row_sum("rocky_km2", "coral_km2"))
        .where(F.col("km2") > 0)
        .drop("rocky_km2", "coral_km2")
    )
    exp = single.unionByName(dual).withColumn(
        "expos_raw", S.r_ifelse((F.col("tonnes") > 0) & (F.col("km2") > 0), F.col("tonnes") / F.col("km2"), F.lit(0.0))
    )
    exp = exp.withColumn("expos_prod_max", W.peak_reference("expos_raw", "product", 1 - 0.35)).withColumn(
        "exposure", S.log_rescale("expos_raw", "expos_prod_max")
    ).drop("km2", "expos_raw", "expos_prod_max")
    gap_fill = exp.select("rgn_id", "product", "year", F.when(F.col("exposure").isNull(), "prod_average").otherwise("0").alias("gap_fill"))
    exp = W.mean_gapfill(exp, "exposure", "product")
    fish_oil = harvest.where(F.col("product") == "fish_oil").join(
        fis_status.select("rgn_id", (F.col("score") / 100).alias("exposure")), "rgn_id", "left"
    )
    exp = exp.unionByName(fish_oil)
    # risk
    cy = layers.narrow("np_cyanide", id_num="rgn_id", val_num="score").where(F.col("score").isNotNull() & (F.col("score") > 0))
    bl = layers.narrow("np_blast", id_num="rgn_id", val_num="score").where(F.col("score").isNotNull() & (F.col("score") > 0))
    orn = cy.select("rgn_id").unionByName(bl.select("rgn_id")).distinct().withColumn("ornamentals", F.lit(1.0))
    base = harvest.select("rgn_id").distinct()
    risk_w = base.join(orn, "rgn_id", "left").select(
        "rgn_id", F.lit(1.0).alias("corals"), F.lit(0.0).alias("sponges"), F.lit(0.0).alias("shells"),
        F.coalesce("ornamentals", F.lit(0.0)).alias("ornamentals"),
    )
    risk = R.unpivot(risk_w, ["rgn_id"], ["corals", "sponges", "shells", "ornamentals"], "product", "risk")
    sust = J.join_null_safe(exp, risk, ["rgn_id", "product"], "left").withColumn("sustainability", 1 - S.row_mean("exposure", "risk"))
    sust = sust.withColumn("product_status", F.col("tonnes_rel") * F.col("sustainability")).where(F.col("rgn_name") != "DISPUTED")
    status_all = (
        sust.where(F.col("product_status").isNotNull() & F.col("prod_weight").isNotNull())
        .groupBy("rgn_id", "year")
        .agg(S.weighted_mean("product_status", "prod_weight", na_rm=False).alias("status"))
        .where(F.col("status").isNotNull())
    )
    status = status_all.where(F.col("year") == status_year).select("rgn_id", (S.r_round("status", 4) * 100).alias("score"))
    trend = (
        status_all.where((F.col("year") <= status_year) & (F.col("year") > status_year - 5))
        .groupBy("rgn_id")
        .agg(S.clamp(S.trend_slope("status", "year"), -1.0, 1.0).alias("score"))
    )
    sc = scores_frame(status, "NP", "status", "rgn_id").unionByName(scores_frame(trend, "NP", "trend", "rgn_id"))
    rp = refpoint(spark, "NP", "Harvest peak within region times 0.65 buffer", "varies for each region")
    return GoalResult(sc, rp, {"np_exposure_gapfill": gap_fill})
