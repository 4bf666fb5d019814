"""Livelihoods (LIV) and economies (ECO) sub-goals.

Country-level status and trend are computed per metric (jobs, revenue, wage), aggregated from countries to regions
with weights, then gap filled georegionally. Every step is a grouped aggregate or an equi join; the only global value
(the best PPP-adjusted wage) is a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import joins as J
from ..operators import reshape as R
from ..session import stored
from ..sources.layers import LayerStore
from .extensions import gapfill_georegions, georegions_wide
from .goals import GoalResult, refpoint, scores_frame

STATUS_LAYERS = [f"le_{m}_{p}_{k}_value" for m in ("jobs", "rev", "wage") for p in ("cur", "ref") for k in ("base", "adj")]
FIELDS = ["cur_base_value", "ref_base_value", "cur_adj_value", "ref_adj_value"]


@dataclass
class CountryFixes:
    """Country-to-region lookup repairs of a scenario: key recodes, extra lookup rows, excluded (landlocked) keys."""

    recode: Mapping[str, str] = field(default_factory=dict)
    extra_rows: Sequence[tuple[int, str, str]] = ()  # (rgn_id, rgn_name, cntry_key)
    landlocked: Sequence[str] = ()


# fixed values: the global scenario's country fixes
GLOBAL_FIXES = CountryFixes(
    recode={
        "SCG": "MNE", "Aruba": "ABW", "Bonaire": "ANT", "Curacao": "ANT", "Sint Eustatius": "ANT", "Saba": "ANT",
        "Brunei": "BRN", "Malaysia": "MYS",
    },
    extra_rows=[(221, "Northern Saint-Martin", "BLM"), (209, "China", "HKG"), (209, "China", "MAC")],
    landlocked=["BDI", "BOL", "BWA", "CHE", "LUX", "MKD", "MWI", "PRY", "PSE", "SCG", "SVK", "SWZ", "TKM", "UGA", "ZMB"],
)

COMPONENT = {"LIV": "livelihood", "ECO": "economy"}


def _country_status(layers: LayerStore) -> DataFrame:
    long = layers.select_many(STATUS_LAYERS).select(
        F.col("id_chr").alias("cntry_key"), F.col("category").alias("sector"), "val_num", "layer"
    )
    long = long.withColumns(
        {
            "metric": F.regexp_replace("layer", r"le_(jobs|rev|wage)_(.*)", "$1"),
            "field": F.regexp_replace("layer", r"le_(jobs|rev|wage)_(.*)", "$2"),
        }
    )
    model = R.pivot(long, ["metric", "cntry_key", "sector"], "field", FIELDS, "val_num")
    nz = (F.col("ref_base_value") != 0) & (F.col("ref_adj_value") != 0)
    jobs_rev = (
        model.where(nz & F.col("metric").isin("jobs", "rev"))
        .groupBy("metric", "cntry_key")
        .agg(
            S.safe_div(
                S.safe_div(S.sum0("cur_base_value"), S.sum0("ref_base_value")),
                S.safe_div(F.avg("cur_adj_value"), F.avg("ref_adj_value")),
            ).alias("score"),
            F.count(F.lit(1)).alias("n_sector"),
        )
    )
    t0 = (
        model.where((F.col("metric") == "wage") & nz)
        .withColumn("w_prime_i", S.safe_div(S.safe_div("cur_base_value", "ref_base_value"), S.safe_div("cur_adj_value", "ref_adj_value")))
        .groupBy("metric", "cntry_key")
        .agg(F.avg("w_prime_i").alias("w_prime"), F.count(F.lit(1)).alias("n_sector"))
    )
    ppp = layers.narrow("le_gdp_pc_ppp", id_chr="cntry_key", year="year", val_num="usd")
    p = ppp.groupBy("cntry_key").agg(S.latest("usd", "year").alias("ppp_last")).where(F.col("ppp_last").isNotNull())
    t2 = t0.join(p, "cntry_key", "inner").select("metric", "cntry_key", (F.col("w_prime") * F.col("ppp_last")).alias("score"), "n_sector")
    wage = t2.withColumn("score", S.safe_div("score", t2.agg(F.max("score")).scalar()))
    combined = jobs_rev.unionByName(wage)
    wide = R.pivot(combined, ["cntry_key"], "metric", ["jobs", "rev", "wage"], "score")
    liv = wide.select("cntry_key", F.lit("livelihood").alias("component"), S.row_mean("jobs", "wage").alias("value"))
    eco = combined.where(F.col("metric") == "rev").select("cntry_key", F.lit("economy").alias("component"), F.col("score").alias("value"))
    return liv.unionByName(eco).where(F.col("value").isNotNull()).withColumn("score", S.clamp("value", hi=1.0))


def _country_trend(layers: LayerStore) -> DataFrame:
    adj = layers.narrow("le_unemployment", id_chr="cntry_key", year="year", val_num="percent").select(
        F.lit("jobs").alias("metric"), "cntry_key", "year", (100 - F.col("percent")).alias("value")
    ).unionByName(
        layers.narrow("le_gdp", id_chr="cntry_key", year="year", val_num="usd").select(
            F.lit("rev").alias("metric"), "cntry_key", "year", F.col("usd").alias("value")
        )
    )
    parts = []
    for metric in ("jobs", "rev", "wage"):
        parts.append(
            layers.narrow(f"le_{metric}_sector_year", id_chr="cntry_key", category="sector", year="year", val_num="base_value")
            .withColumn("metric", F.lit(metric))
        )
    mcsy = parts[0].unionByName(parts[1]).unionByName(parts[2])
    mcsy = J.join_null_safe(mcsy, adj.withColumnRenamed("value", "adj_value"), ["metric", "cntry_key", "year"], "left")
    mcsy = mcsy.withColumn("adj_value", F.when(F.col("metric") == "wage", F.lit(1.0)).otherwise(F.col("adj_value"))).withColumn(
        "value", S.safe_div("base_value", "adj_value")
    )
    mcs = (
        mcsy.where(F.col("value").isNotNull())
        .groupBy("metric", "cntry_key", "sector")
        .agg(S.clamp(S.trend_slope("value", "year"), -1.0, 1.0).alias("trend"), F.sum("value").alias("value_sum"))
    )
    wage = mcs.where(F.col("metric") == "wage").groupBy("metric", "cntry_key").agg(S.mean_strict("trend").alias("trend"))
    jr = mcs.where(F.col("metric").isin("jobs", "rev")).groupBy("metric", "cntry_key").agg(
        S.weighted_mean("trend", "value_sum", na_rm=False).alias("trend")
    )
    mc = wage.unionByName(jr)
    liv = (
        mc.where(F.col("metric").isin("jobs", "wage") & F.col("trend").isNotNull())
        .groupBy("cntry_key")
        .agg(F.avg("trend").alias("score"))
        .withColumn("component", F.lit("livelihood"))
    )
    eco = mc.where(F.col("metric") == "rev").select("cntry_key", F.col("trend").alias("score"), F.lit("economy").alias("component"))
    return liv.unionByName(eco)


def country_region_lookup(layers: LayerStore, fixes: CountryFixes | None, region_labels: str = "rgn_labels") -> DataFrame:
    spark = layers.df.sparkSession
    cr = layers.narrow("cntry_rgn", id_num="rgn_id", id_chr="cntry_key")
    labels = layers.narrow(region_labels, id_num="rgn_id", val_chr="rgn_name")
    cr = cr.join(labels, "rgn_id", "left").select("rgn_id", "rgn_name", "cntry_key")
    if fixes is not None:
        cr = cr.withColumn("cntry_key", S.recode("cntry_key", dict(fixes.recode)))
        if fixes.extra_rows:
            cr = cr.unionByName(spark.createDataFrame(list(fixes.extra_rows), "rgn_id int, rgn_name string, cntry_key string"))
    return cr


def _weights(layers: LayerStore, workforce_year: int, rev_min_year: int) -> DataFrame:
    wf = layers.narrow("le_workforcesize_adj", id_chr="cntry_key", year="year", val_num="jobs").where(F.col("year") == workforce_year)
    rev = layers.narrow("le_revenue_adj", id_chr="cntry_key", year="year", val_num="usd").where(F.col("year") >= rev_min_year)
    return wf.select("cntry_key", F.col("jobs").alias("w"), F.lit("livelihood").alias("component")).unionByName(
        rev.groupBy("cntry_key").agg(S.latest("usd", "year").alias("w")).withColumn("component", F.lit("economy"))
    )


def _to_regions(country: DataFrame, lookup: DataFrame, weights: DataFrame) -> DataFrame:
    """Countries -> regions: weighted mean (strict), falling back to the plain mean, with member lists."""
    s = country.join(lookup, "cntry_key", "left").join(weights, ["cntry_key", "component"], "left")
    return (
        s.groupBy("component", "rgn_id", "rgn_name")
        .agg(
            S.concat_members("cntry_key", F.col("w").isNotNull()).alias("cntry_w"),
            S.concat_members("cntry_key", F.col("w").isNull()).alias("cntry_w_na"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("w").isNull()).alias("n_w_na"),
            S.weighted_mean("score", "w", na_rm=False).alias("score_w_avg"),
            S.mean_strict("score").alias("score_avg"),
            S.sum0("w").alias("w_sum"),
        )
        .withColumn("score", F.coalesce("score_w_avg", "score_avg"))
    )


def liv_eco_pair(
    layers: LayerStore,
    liv_workforcesize_year: int,
    eco_rev_adj_min_year: int,
    fixes: CountryFixes | None = None,
    region_labels: str = "rgn_labels",
    gapfill: bool = True,
    materialize: bool = True,
    fail_on_unmatched: bool = False,
) -> dict[str, GoalResult]:
    """LIV and ECO together: the country status/trend and the country-to-region aggregation are computed once for
    both components (region-sized tables, checkpointed when ``materialize``), then each sub-goal is gap filled."""
    spark = layers.df.sparkSession
    lookup = country_region_lookup(layers, fixes, region_labels)
    weights = _weights(layers, liv_workforcesize_year, eco_rev_adj_min_year)
    landlocked = list(fixes.landlocked) if fixes else []
    georegions = georegions_wide(layers)

    st = _country_status(layers).where(S.not_in_safe("cntry_key", landlocked))
    tr = _country_trend(layers).where(S.not_in_safe("cntry_key", landlocked))
    unmatched = J.unmatched_keys(st.select("cntry_key"), lookup, ["cntry_key"]).withColumn("part", F.lit("status")).unionByName(
        J.unmatched_keys(tr.select("cntry_key"), lookup, ["cntry_key"]).withColumn("part", F.lit("trend"))
    )
    if fail_on_unmatched:  # the reference stops when a country has no region
        J.assert_no_rows(unmatched, "LIV/ECO country keys missing from the country-to-region lookup")
    s_r = _to_regions(st, lookup, weights)
    g_r = _to_regions(tr, lookup, weights).where(F.col("rgn_id").isNotNull())
    if materialize:
        s_r, g_r = stored(s_r, "liveco-status"), stored(g_r, "liveco-trend")

    def finish(df: DataFrame, component: str, subgoal: str, dimension: str, scale: float) -> tuple[DataFrame, DataFrame]:
        data = df.where(F.col("component") == component).select("rgn_id", "score", "w_sum")
        if gapfill:
            filled = gapfill_georegions(data, georegions, "rgn_id", "score", "w_sum", r0_to_na=True)
            out = filled.select("rgn_id", "score")
        else:
            filled, out = data, data.select("rgn_id", "score")
        return scores_frame(out.withColumn("score", F.col("score") * scale), subgoal, dimension, "rgn_id"), filled

    results = {}
    for subgoal, component in COMPONENT.items():
        status, st_attr = finish(s_r, component, subgoal, "status", 100.0)
        trend, tr_attr = finish(g_r, component, subgoal, "trend", 1.0)
        results[subgoal] = GoalResult(
            status.unionByName(trend),
            refpoint(spark, subgoal, "country-level relative change, aggregated to regions"),
            {"country_region_unmatched": unmatched, "status_regions": s_r, "trend_regions": g_r,
             f"{subgoal.lower()}_status_gapfill": st_attr, f"{subgoal.lower()}_trend_gapfill": tr_attr},
        )
    return results


def liv_eco(
    layers: LayerStore,
    subgoal: str,
    liv_workforcesize_year: int,
    eco_rev_adj_min_year: int,
    fixes: CountryFixes | None = None,
    region_labels: str = "rgn_labels",
    gapfill: bool = True,
) -> GoalResult:
    """One sub-goal (``'LIV'`` or ``'ECO'``), the reference's calling convention."""
    return liv_eco_pair(layers, liv_workforcesize_year, eco_rev_adj_min_year, fixes, region_labels, gapfill)[subgoal]
