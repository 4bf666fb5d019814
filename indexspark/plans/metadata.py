"""Scenario metadata: goal tree, dimensions and model parameters.

These are fixed values of the scored scenario (goal codes, parents, weights, calculation order, hierarchy order,
names and the status-year parameters of each model call).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: goal table (order_color, order_hierarchy, order_calculate, goal, parent, name, weight)
GOALS = [
    (1.2, 1.0, 15, "FP", None, "Food Provision", 1.0),
    (1.1, 1.1, 1, "FIS", "FP", "Fisheries", 0.5),
    (1.3, 1.2, 2, "MAR", "FP", "Mariculture", 0.5),
    (2.0, 2.0, 3, "AO", None, "Artisanal Fishing Opportunity", 1.0),
    (3.0, 3.0, 4, "NP", None, "Natural Products", 1.0),
    (4.0, 4.0, 5, "CS", None, "Carbon Storage", 1.0),
    (5.0, 5.0, 6, "CP", None, "Coastal Protection", 1.0),
    (6.0, 6.0, 7, "TR", None, "Tourism & Recreation", 1.0),
    (7.2, 7.0, 16, "LE", None, "Coastal Livelihoods & Economies", 1.0),
    (7.1, 7.1, 8, "LIV", "LE", "Livelihoods", 0.5),
    (7.3, 7.2, 9, "ECO", "LE", "Economies", 0.5),
    (8.2, 8.0, 17, "SP", None, "Sense of Place", 1.0),
    (8.1, 8.1, 10, "ICO", "SP", "Iconic Species", 0.5),
    (8.3, 8.2, 11, "LSP", "SP", "Lasting Special Places", 0.5),
    (9.0, 9.0, 12, "CW", None, "Clean Waters", 1.0),
    (10.2, 10.0, 18, "BD", None, "Biodiversity", 1.0),
    (10.1, 10.1, 13, "HAB", "BD", "Habitats", 0.5),
    (10.3, 10.2, 14, "SPP", "BD", "Species", 0.5),
]
GOALS_SCHEMA = "order_color double, order_hierarchy double, order_calculate int, goal string, parent string, name string, weight double"

# fixed values: the six dimensions
DIMENSIONS = ["pressures", "resilience", "status", "trend", "future", "score"]

# fixed values: configuration constants of the scenario
PRESSURES_GAMMA = 0.5
RESILIENCE_GAMMA = 0.5
GOAL_DISCOUNT = 1.0
GOAL_BETA = 0.67
DEFAULT_TREND = 0.0

# status-year parameters used when the goal models run on the proxy layer store (driver tables span 1995-2001)
PROXY_PARAMS = {
    "FIS": {"status_year": 2000},
    "MAR": {"status_year": 2000},
    "AO": {"status_year": 2000},
    "NP": {"status_year": 2000},
    "TR": {"status_year": 2000, "pct_ref": 90},
    "LIV": {"liv_workforcesize_year": 2000, "eco_rev_adj_min_year": 1997},
    "ECO": {"liv_workforcesize_year": 2000, "eco_rev_adj_min_year": 1997},
    "LSP": {"status_year": 2000, "ref_pct_cmpa": 30, "ref_pct_cp": 30},
}


# layers each leaf goal reads (a single-goal query plans only these; a run on layer files takes the goals that have them)
GOAL_LAYERS = {
    "CW": ["po_pathogens", "po_nutrients_3nm", "po_chemicals_3nm", "po_trash", "cw_pesticide_trend", "cw_fertilizer_trend",
           "cw_coastalpopn_trend", "cw_pathogen_trend"],
    "SPP": ["spp_status", "spp_trend"],
    "HAB": ["hab_health", "hab_trend", "hab_extent"],
    "CS": ["hab_health", "hab_trend", "hab_extent"],
    "CP": ["hab_health", "hab_trend", "hab_extent"],
    "AO": ["ao_access", "ao_need"],
    "ICO": ["ico_spp_extinction_status", "ico_spp_popn_trend"],
    "LSP": ["rgn_area_inland1km", "rgn_area_offshore3nm", "lsp_prot_area_offshore3nm", "lsp_prot_area_inland1km"],
    "MAR": ["mar_harvest_tonnes", "mar_harvest_species", "mar_sustainability_score", "mar_coastalpopn_inland25mi"],
    "TR": ["tr_jobs_tourism", "tr_jobs_pct_tourism", "tr_unemployment", "tr_jobs_total", "tr_sustainability", "rgn_global",
           "tr_travelwarnings", "le_popn"],
    "FIS": ["fis_meancatch", "fis_b_bmsy", "fis_proparea_saup2rgn"],
    "NP": ["np_harvest_tonnes", "np_harvest_tonnes_relative", "np_harvest_product_weight", "rgn_labels", "hab_extent",
           "np_cyanide", "np_blast"],
    "LIV": [f"le_{m}_{p}_{k}_value" for m in ("jobs", "rev", "wage") for p in ("cur", "ref") for k in ("base", "adj")]
    + ["le_gdp_pc_ppp", "le_workforcesize_adj", "le_revenue_adj", "cntry_rgn", "rgn_labels", "rgn_georegions",
       "le_unemployment", "le_gdp", "le_jobs_sector_year", "le_rev_sector_year", "le_wage_sector_year"],
}
GOAL_LAYERS["ECO"] = GOAL_LAYERS["LIV"]
GOAL_LAYERS["NP"] = GOAL_LAYERS["NP"] + GOAL_LAYERS["FIS"]


def goals_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GOALS, GOALS_SCHEMA)
