"""Weights of goal elements, computed from layers: what each element (habitat, product, sector) contributes to the
pressures and resilience of its goal in a region.

Carbon storage weighs a habitat by extent x storage rank, coastal protection by extent x protection rank, habitats by
presence, natural products by the product's weight in the harvest, livelihoods and economies by the sector's weight.
The result is one row per goal, element and region: the grain of the layers, never that of facts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.layers import LayerStore
from . import goals as G

#: Layers that ``element_weights`` reads, and those that stand in for a sector weight layer.
ELEMENT_LAYERS = ["hab_extent", "np_harvest_product_weight"]
SECTOR_LAYERS = ["le_jobs_cur_base_value", "cntry_rgn"]


def _ranked(extent: DataFrame, goal: str, ranks: Mapping[str, float]) -> DataFrame:
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("habitat"))
    rows = extent.where(S.isin_safe("habitat", list(ranks)))
    return rows.select(F.lit(goal).alias("goal"), F.col("habitat").alias("element"), F.col("rgn_id").alias("region_id"), (F.col("km2") * rank).alias("weight"))


def sector_jobs(layers: LayerStore) -> DataFrame:
    """``region_id, sector, weight``: the current jobs of a sector, countries summed to their regions."""
    jobs = layers.narrow("le_jobs_cur_base_value", id_chr="cntry_key", category="sector", val_num="jobs")
    lookup = layers.narrow("cntry_rgn", id_num="region_id", id_chr="cntry_key")
    return jobs.join(lookup, "cntry_key").groupBy("region_id", "sector").agg(F.sum("jobs").alias("weight"))


def element_weights(layers: LayerStore, sectors: DataFrame | None = None) -> DataFrame:
    """``goal, element, region_id, weight`` of the goals with elements. ``sectors(region_id, sector, weight)`` weighs
    livelihoods and economies; without it the layer ``le_sector_weight`` does. Elements without a weight, or with none
    above zero, have no row: they count nothing."""
    extent = layers.narrow("hab_extent", id_num="rgn_id", category="habitat", val_num="km2")
    present = extent.where(S.isin_safe("habitat", G.HAB_HABITATS)).select(
        F.lit("HAB").alias("goal"), F.col("habitat").alias("element"), F.col("rgn_id").alias("region_id"), F.signum("km2").alias("weight"))
    products = layers.narrow("np_harvest_product_weight", id_num="region_id", category="element", val_num="weight").select(
        F.lit("NP").alias("goal"), "element", "region_id", "weight")
    if sectors is None:
        sectors = layers.narrow("le_sector_weight", id_num="region_id", category="sector", val_num="weight")
    work = sectors.select(F.explode(F.array(F.lit("LIV"), F.lit("ECO"))).alias("goal"), F.col("sector").alias("element"), "region_id", "weight")
    out = _ranked(extent, "CS", G.CS_RANKS).unionByName(_ranked(G.protected_extent(extent), "CP", G.CP_RANKS))
    out = out.unionByName(present).unionByName(products).unionByName(work)
    return out.select("goal", "element", F.col("region_id").cast("int").alias("region_id"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
