"""Layer catalog of the global scenario (re-declared: the scenario's catalog file is not shipped).

Field roles are derived by rule from each file's header (id, category, year, numeric value, text value), with the
overrides the scoring models need; goal targets are the goals whose model reads the layer.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .layers import _exists, catalog_frame, discover_headers

ID_NUM = ("rgn_id", "saup_id", "fao_id", "region_id")
ID_CHR = ("cntry_key", "fao_saup_id", "rgn_name")
CATEGORY = ("habitat", "sector", "product", "level", "component", "type", "species_code", "sciname")
TEXT = ("label", "species", "iucn_cat")

# fixed values: per-layer field overrides where the models select differently from the header rule
OVERRIDES: dict[str, dict] = {
    "fis_proparea_saup2rgn": dict(fld_id_num="saup_id", fld_category="rgn_id", fld_val_num="prop_area"),
    "mar_harvest_species": dict(fld_id_num=None, fld_category="species_code", fld_val_chr="species"),
    "cntry_rgn": dict(fld_id_num="rgn_id", fld_id_chr="cntry_key", fld_val_num=None),
    "tr_travelwarnings": dict(fld_id_chr="rgn_name", fld_val_num="multiplier"),
}

# fixed values: goal targets of the layers each goal model reads
TARGETS: dict[str, Sequence[str]] = {
    "FIS": ["fis_meancatch", "fis_b_bmsy", "fis_proparea_saup2rgn"],
    "MAR": ["mar_harvest_tonnes", "mar_harvest_species", "mar_sustainability_score", "mar_coastalpopn_inland25mi"],
    "FP": ["fp_wildcaught_weight"],
    "AO": ["ao_access", "ao_need"],
    "NP": ["np_harvest_tonnes", "np_harvest_tonnes_relative", "np_harvest_product_weight", "np_blast", "np_cyanide"],
    "CS": ["hab_extent", "hab_health", "hab_trend"],
    "CP": ["hab_extent", "hab_health", "hab_trend"],
    "TR": ["tr_jobs_tourism", "tr_jobs_pct_tourism", "tr_unemployment", "tr_jobs_total", "tr_sustainability", "tr_travelwarnings"],
    "LIV": ["le_jobs_cur_base_value", "le_jobs_ref_base_value", "le_jobs_cur_adj_value", "le_jobs_ref_adj_value",
            "le_wage_cur_base_value", "le_wage_ref_base_value", "le_wage_cur_adj_value", "le_wage_ref_adj_value",
            "le_gdp_pc_ppp", "le_workforcesize_adj", "le_unemployment", "le_jobs_sector_year", "le_wage_sector_year"],
    "ECO": ["le_rev_cur_base_value", "le_rev_ref_base_value", "le_rev_cur_adj_value", "le_rev_ref_adj_value",
            "le_revenue_adj", "le_gdp", "le_rev_sector_year"],
    "LE": ["le_popn", "le_sector_weight"],
    "ICO": ["ico_spp_extinction_status", "ico_spp_popn_trend"],
    "LSP": ["lsp_prot_area_offshore3nm", "lsp_prot_area_inland1km", "rgn_area_inland1km", "rgn_area_offshore3nm"],
    "CW": ["po_pathogens", "po_nutrients_3nm", "po_chemicals_3nm", "po_trash", "cw_pesticide_trend", "cw_fertilizer_trend",
           "cw_coastalpopn_trend", "cw_pathogen_trend"],
    "HAB": ["hab_health", "hab_trend", "hab_extent"],
    "SPP": ["spp_status", "spp_trend"],
    "spatial": ["rgn_global", "rgn_labels", "rgn_georegions", "rgn_georegion_labels", "rgn_area", "cntry_rgn", "cntry_georegions"],
}


def _targets_of(layer: str) -> str | None:
    t = [g for g, lyrs in TARGETS.items() if layer in lyrs]
    return " ".join(t) if t else None


def entry_from_header(layer: str, filename: str, header: Sequence[str]) -> dict:
    """Catalog row for one file: the first id column, the category / year columns, the last remaining column as the
    numeric value, or a text value for label-like columns."""
    cols = [c.lower() for c in header]
    e: dict = dict(layer=layer, filename=filename, targets=_targets_of(layer), name=layer, description=None)
    rest = list(cols)
    for c in cols:
        if c in ID_NUM and "fld_id_num" not in e:
            e["fld_id_num"] = c
            rest.remove(c)
        elif c in ID_CHR and "fld_id_chr" not in e:
            e["fld_id_chr"] = c
            rest.remove(c)
    for c in list(rest):
        if c in CATEGORY and "fld_category" not in e:
            e["fld_category"] = c
            rest.remove(c)
        elif c == "year":
            e["fld_year"] = c
            rest.remove(c)
    for c in list(rest):
        if c in TEXT:
            e["fld_val_chr"] = c
            rest.remove(c)
    if rest:
        e["fld_val_num"] = rest[-1]
    e.update(OVERRIDES.get(layer, {}))
    return e


def catalog_for_dir(spark: SparkSession, layer_dir: str, layers: Iterable[str] | None = None,
                    headers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Catalog DataFrame for every ``<layer>.csv`` (file or folder of part files) in ``layer_dir``, or the listed layers.

    The folder may be in any store that Spark reads: headers are found by one Spark job over its files.
    """
    root = layer_dir.rstrip("/")
    known = {fn: tuple(h) for fn, h in (headers or {}).items()}
    names = None if layers is None else [f"{n}.csv" for n in layers]
    paths = [f"{root}/*.csv"] if names is None else [f"{root}/{fn}" for fn in names if fn not in known]
    gone = [p for p in paths if names is not None and not _exists(spark, p)]
    if gone:
        raise ValueError(f"layer files not found: {gone}")
    if paths:
        known |= {fn: h for fn, (h, _) in discover_headers(spark, paths, names).items() if fn not in known}
    return catalog_frame(spark, [entry_from_header(fn[: -len(".csv")], fn, known[fn]) for fn in sorted(known if names is None else names) if fn in known])
