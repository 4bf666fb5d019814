"""Proxy layer store derived from the driver tables.

Only two goals have complete inputs in the reference scenario, so every goal model is exercised on layers that Spark
derives from the driver tables. Region = nation (``rgn_id = nationkey + 1``; 0 stays the global region), world
region = georegion, year = order or ship year, category = part type / brand / name or customer segment, values =
shares, sums and means of quantities, prices and discounts. All layers grow with the data.

Layers are produced by *families*: one scan and one aggregation per family, then an unpivot into its layers, so a
store of ~60 layers costs about a dozen aggregations, not 60 scans. Build once, write it with
``LayerStore.write`` (partitioned by layer), and every goal reads only its partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import recode, safe_div
from ..operators.windows import share_by_join, share_of_total
from ..session import scratch_path
from .layers import LONG_COLUMNS, LayerStore, to_long
from .tables import Tables, year_of

# fixed values: p_type -> habitat (HAB, CS, CP, NP exposure) and p_type -> natural product (NP)
TYPE_HABITAT = {
    "STANDARD": "coral",
    "ECONOMY": "mangrove",
    "PROMO": "saltmarsh",
    "LARGE": "seagrass",
    "SMALL": "soft_bottom",
    "MEDIUM": "rocky_reef",
}
TYPE_PRODUCT = {
    "STANDARD": "corals",
    "ECONOMY": "ornamentals",
    "PROMO": "shells",
    "LARGE": "sponges",
    "SMALL": "seaweeds",
    "MEDIUM": "fish_oil",
}
# fixed values: display-name travel warnings; the last two names match no region on purpose
TRAVEL_WARNINGS = [("NATION_3", 0.25), ("NATION_7", 0.5), ("NATION_11", 0.75), ("Nepal", 0.5), ("Republic of South Sudan", 0.25)]


def rgn(col: str) -> Column:
    return (F.col(col) + 1).cast("int")


def _wide_to_long(df: DataFrame, layer_cols: dict[str, str], **keys) -> DataFrame:
    """Unpivot one aggregated frame into several layers: ``layer_cols`` maps layer name -> value column."""
    stacked = df.select(
        *[F.col(c) for c in {k for k in keys.values() if isinstance(k, str)}],
        F.explode(
            F.array(*[F.struct(F.lit(layer).alias("__layer"), F.col(col).cast("double").alias("__v")) for layer, col in layer_cols.items()])
        ).alias("__s"),
    )
    return to_long(stacked, F.col("__s.__layer"), val_num=F.col("__s.__v"), **keys)


def _ratio(num: Column, den: Column) -> Column:
    """Mean recomposed from partial sums: ``sum(x) / count(x)``; NULL when there is no row."""
    return safe_div(num, den)


def _sum_if(cond: Column, x: str | Column) -> Column:
    return F.sum(F.when(cond, F.col(x) if isinstance(x, str) else x))


def _count_if(cond: Column, n: str | Column) -> Column:
    """Re-aggregated count of the rows meeting ``cond``: 0 (not NULL) when there are none, like ``avg(indicator)``."""
    return F.coalesce(_sum_if(cond, n), F.lit(0))


# ---------------------------------------------------------------- shared fact aggregates
#
# Every family aggregates a fact table on the keys its layers need. What several families share is stored at the grain
# of dimension attributes (nation, type, brand, segment, year, flags), whose size does not grow with the facts; nothing
# of fact size is written. The fact columns that reach a shuffle are those that the wanted layers read.


def _shared(t: Tables, key: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
    """Build a shared aggregate once per ``Tables``, write it as Parquet under the session's checkpoint directory and
    read it back: later plans know its size and read only their columns."""
    cache = t.__dict__.setdefault("_shared", {})
    if key not in cache:
        df = build(t)
        if t.materialize_shared:
            path = scratch_path(t.spark, key)
            df.write.parquet(path)
            df = t.spark.read.schema(df.schema).parquet(path)
        cache[key] = df
    return cache[key]


def _line_measures() -> list[Column]:
    d, q, tax = F.col("l_discount"), F.col("l_quantity"), F.col("l_tax")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(q).alias("q"),
        F.sum(d).alias("d"),
        F.sum(tax).alias("tax"),
        F.sum("l_extendedprice").alias("rev"),
        F.sum(F.when(q > 48, q).otherwise(0.0)).alias("q_gt48"),
        F.sum(F.when(d >= 0.08, q)).alias("q_d08"),
        F.count(F.when(d >= 0.08, 1)).alias("n_d08"),
        F.count(F.when(d == 0, 1)).alias("n_d0"),
        F.count(F.when(d >= 0.1, 1)).alias("n_d10"),
    ]


def _line_supp(t: Tables) -> DataFrame:
    """lineitem by supplier and flags (the map-side combine collapses a hot supplier), with the supplier's nation."""
    pre = t.lineitem.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(*_line_measures())
    s = t.supplier.select("s_suppkey", "s_nationkey")
    return pre.join(s, F.col("l_suppkey") == F.col("s_suppkey"))


def _line_parts(t: Tables, *columns: str) -> DataFrame:
    """lineitem with its supplier's nation and the part's ``columns``. Supplier and part together nearly identify a row,
    so aggregating before these joins would not collapse anything; a hot key is split by the adaptive skew join."""
    s = t.supplier.select("s_suppkey", "s_nationkey")
    p = t.part.select("p_partkey", *columns)
    return t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))


def _build_line_type(t: Tables) -> DataFrame:
    keys = ["s_nationkey", "p_type", "p_brand", year_of("l_shipdate").alias("year"), "l_returnflag", "l_linestatus"]
    return _line_parts(t, "p_type", "p_brand").groupBy(*keys).agg(*_line_measures())


def _line_type(t: Tables) -> DataFrame:
    """lineitem by nation, part type, brand, ship year and flags, stored once."""
    return _shared(t, "line_type", _build_line_type)


def _build_order_cust(t: Tables) -> DataFrame:
    pre = t.orders.groupBy("o_custkey", year_of("o_orderdate").alias("year"), "o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_totalprice").alias("price"),
        F.count(F.when(F.col("o_totalprice") > 400000, 1)).alias("n_gt400k"),
    )
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_name")
    return (
        pre.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "c_mktsegment", "year", "o_orderpriority", "o_orderstatus")
        .agg(F.sum("n").alias("n"), F.sum("price").alias("price"), F.sum("n_gt400k").alias("n_gt400k"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    )


def _order_cust(t: Tables) -> DataFrame:
    """orders by customer nation, segment, order year, priority and status, stored once."""
    return _shared(t, "order_cust", _build_order_cust)


def _customers(t: Tables, *keys: Column) -> DataFrame:
    """Customers with orders, by nation and ``keys`` of their orders."""
    seen = t.orders.select("o_custkey", *keys).distinct()
    c = t.customer.select("c_custkey", rgn("c_nationkey").alias("rgn_id"))
    names = [x for x in seen.columns if x != "o_custkey"]
    return seen.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("rgn_id", *names).agg(F.count(F.lit(1)).cast("double").alias("customers"))


# ---------------------------------------------------------------- families


def fam_line_nation(t: Tables) -> DataFrame:
    lf = _line_supp(t)
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    n = F.col("n")

    def mean_if(cond: Column, x: str) -> Column:
        return _ratio(_sum_if(cond, x), _sum_if(cond, n))

    g = lf.groupBy(rgn("s_nationkey").alias("rgn_id")).agg(
        (mean_if(rf == "R", "d") * 10).alias("po_pathogens"),
        (_ratio(F.sum("tax"), F.sum(n)) * 12.5).alias("po_nutrients_3nm"),
        (mean_if(ls == "F", "d") * 10).alias("po_chemicals_3nm"),
        (mean_if(rf == "A", "q") / 50).alias("po_trash"),
        ((mean_if(rf == "N", "d") - 0.05) * 10).alias("cw_pesticide_trend"),
        ((mean_if(rf == "A", "tax") - 0.04) * 12.5).alias("cw_fertilizer_trend"),
        ((mean_if(ls == "O", "q") - 25.5) / 25.5).alias("cw_coastalpopn_trend"),
        ((mean_if(ls == "F", "d") - 0.05) * 10).alias("cw_pathogen_trend"),
        (F.lit(1.0) + _ratio(F.sum("d"), F.sum(n)) * 60).alias("tr_sustainability"),
        safe_div(F.sum(F.when(rf == "N", F.col("rev")).otherwise(0.0)), F.sum("rev")).alias("fp_wildcaught_weight"),
        (_ratio(_count_if(rf == "R", "n_d0"), F.sum(n)) * 10).alias("np_blast"),
        (_ratio(_count_if(rf == "N", "n_d10"), F.sum(n)) * 10).alias("np_cyanide"),
    )
    cols = [c for c in g.columns if c != "rgn_id"]
    return _wide_to_long(g, {c: c for c in cols}, id_num="rgn_id")


def fam_order_nation(t: Tables) -> DataFrame:
    of = _order_cust(t)
    n = F.col("n")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    g = of.groupBy(rgn("c_nationkey").alias("rgn_id")).agg(
        (_ratio(F.sum("price"), F.sum(n)) / 500000).alias("spp_status"),
        (_ratio(_count_if(urgent, n), F.sum(n)) - 0.2).alias("spp_trend"),
        _ratio(_count_if(F.col("o_orderstatus") == "F", n), F.sum(n)).alias("ao_access"),
        F.sum(n).cast("double").alias("rgn_area_inland1km"),
        (F.sum(n) * 0.5).alias("rgn_area_offshore3nm"),
    ).join(_customers(t).withColumnRenamed("customers", "rgn_area"), "rgn_id", "left")
    cols = [c for c in g.columns if c != "rgn_id"]
    return _wide_to_long(g, {c: c for c in cols}, id_num="rgn_id")


def fam_order_nation_year(t: Tables) -> DataFrame:
    of = _order_cust(t)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    st = F.col("o_orderstatus")
    n = F.col("n")
    tot = F.sum(n)
    g = of.groupBy(rgn("c_nationkey").alias("rgn_id"), F.col("n_name").alias("cntry_key"), "year").agg(
        (_ratio(_count_if(urgent, n), tot) * 2).alias("ao_need"),
        F.coalesce(_sum_if(urgent, n), F.lit(0)).cast("double").alias("tr_jobs_tourism"),
        F.when(F.col("year") <= 1996, _ratio(F.coalesce(_sum_if(urgent, n), F.lit(0)), tot)).alias("tr_jobs_pct_tourism"),
        _ratio(F.coalesce(_sum_if(st == "F", n), F.lit(0)), tot).alias("tr_unemployment"),
        tot.cast("double").alias("tr_jobs_total"),
        F.coalesce(_sum_if(urgent, "n_gt400k"), F.lit(0)).cast("double").alias("le_popn"),
        F.coalesce(_sum_if((st == "F") & urgent, n), F.lit(0)).cast("double").alias("lsp_prot_area_inland1km"),
        F.coalesce(_sum_if((st == "F") & (F.col("o_orderpriority") == "2-HIGH"), n), F.lit(0)).cast("double").alias("lsp_prot_area_offshore3nm"),
        (_ratio(F.sum("price"), tot) / 1000).alias("le_gdp_pc_ppp"),
        F.sum("price").alias("le_revenue_adj"),
        (_ratio(F.coalesce(_sum_if(st == "F", n), F.lit(0)), tot) * 100).alias("le_unemployment"),
        F.sum("price").alias("le_gdp"),
    )
    people = _customers(t, year_of("o_orderdate").alias("year"))
    g = g.join(people, ["rgn_id", "year"], "left").withColumns(
        {"mar_coastalpopn_inland25mi": F.col("customers"), "le_workforcesize_adj": F.col("customers")}
    )
    by_rgn = ["ao_need", "tr_jobs_tourism", "tr_jobs_pct_tourism", "tr_unemployment", "tr_jobs_total", "le_popn",
              "mar_coastalpopn_inland25mi", "lsp_prot_area_inland1km", "lsp_prot_area_offshore3nm"]
    by_cntry = ["le_gdp_pc_ppp", "le_workforcesize_adj", "le_revenue_adj", "le_unemployment", "le_gdp"]
    a = _wide_to_long(g, {c: c for c in by_rgn}, id_num="rgn_id", year="year")
    b = _wide_to_long(g, {c: c for c in by_cntry}, id_chr="cntry_key", year="year")
    return a.unionByName(b)


def fam_order_nation_sector(t: Tables) -> DataFrame:
    of = _order_cust(t)
    y = F.col("year")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    aggs = []
    for period, yr in (("cur", 2000), ("ref", 1996)):
        for kind, cond in (("base", F.lit(True)), ("adj", urgent)):
            sel = (y == yr) & cond
            aggs += [
                F.coalesce(_sum_if(sel, "n"), F.lit(0)).cast("double").alias(f"le_jobs_{period}_{kind}_value"),
                F.coalesce(_sum_if(sel, "price"), F.lit(0.0)).alias(f"le_rev_{period}_{kind}_value"),
                _ratio(_sum_if(sel, "price"), _sum_if(sel, "n")).alias(f"le_wage_{period}_{kind}_value"),
            ]
    g = of.groupBy(F.col("n_name").alias("cntry_key"), F.col("c_mktsegment").alias("sector")).agg(*aggs)
    cols = [c for c in g.columns if c.startswith("le_")]
    sy = of.groupBy(F.col("n_name").alias("cntry_key"), F.col("c_mktsegment").alias("sector"), "year").agg(
        F.sum("n").cast("double").alias("le_jobs_sector_year"),
        F.sum("price").alias("le_rev_sector_year"),
        _ratio(F.sum("price"), F.sum("n")).alias("le_wage_sector_year"),
    )
    a = _wide_to_long(g, {c: c for c in cols}, id_chr="cntry_key", category="sector")
    b = _wide_to_long(sy, {c: c for c in ("le_jobs_sector_year", "le_rev_sector_year", "le_wage_sector_year")},
                      id_chr="cntry_key", category="sector", year="year")
    return a.unionByName(b)


def fam_line_nation_type(t: Tables) -> DataFrame:
    lp = _line_type(t).withColumn("habitat", recode("p_type", TYPE_HABITAT)).withColumn("product", recode("p_type", TYPE_PRODUCT))
    is_n = F.col("l_returnflag") == "N"
    g = lp.groupBy(rgn("s_nationkey").alias("rgn_id"), "habitat", "product", "l_linestatus").agg(
        F.sum("q").alias("q"), F.sum("n").alias("n"),
        _sum_if(is_n, "d").alias("dn"),
        F.coalesce(_sum_if(is_n, "n"), F.lit(0)).alias("nn"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("q_gt48")).otherwise(0.0)).alias("ext"),
        F.sum("rev").alias("rev"),
    )
    h = g.groupBy("rgn_id", "habitat", "product").agg(
        (F.sum("q") / F.sum("n") / 26).alias("hab_health"),
        (safe_div(F.sum("dn"), F.sum("nn")) - 0.05).alias("hab_trend_raw"),
        F.sum("ext").alias("hab_extent"),
        F.sum("rev").alias("rev"),
    ).withColumn("hab_trend", F.col("hab_trend_raw") * 10)
    hab = _wide_to_long(h, {"hab_health": "hab_health", "hab_trend": "hab_trend", "hab_extent": "hab_extent"},
                        id_num="rgn_id", category="habitat")
    mang = to_long(
        g.where(F.col("habitat") == "mangrove"),
        F.lit("hab_extent"),
        id_num="rgn_id",
        category=F.when(F.col("l_linestatus") == "O", F.lit("mangrove_inland1km")).otherwise(F.lit("mangrove_offshore")),
        val_num="ext",
    )
    w = to_long(h.withColumn("w", share_of_total("rev", "rgn_id")), "np_harvest_product_weight",
                id_num="rgn_id", category="product", val_num="w")
    return hab.unionByName(mang).unionByName(w)


def fam_np_harvest(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    lp = _line_type(t).where(F.col("l_returnflag") == "A").withColumn("product", recode("p_type", TYPE_PRODUCT))
    g = lp.groupBy(rgn("s_nationkey").alias("rgn_id"), "product", "year").agg(F.sum("q").alias("tonnes"))
    peak = F.max("tonnes").over(Window.partitionBy("rgn_id", "product")) * 0.65
    g = g.withColumn("tonnes_rel", F.least(F.lit(1.0), safe_div("tonnes", peak)))
    return _wide_to_long(g, {"np_harvest_tonnes": "tonnes", "np_harvest_tonnes_relative": "tonnes_rel"},
                         id_num="rgn_id", category="product", year="year")


def _brand_no(col: str = "p_brand") -> Column:
    return F.regexp_extract(F.col(col), r"#(\d+)", 1).cast("int")


def fam_mar(t: Tables) -> DataFrame:
    lp = _line_type(t).withColumn("species_code", _brand_no())
    sparse = (F.col("l_returnflag") == "R") & (F.col("n_d08") > 0)
    tonnes = lp.where(sparse).groupBy(rgn("s_nationkey").alias("rgn_id"), "species_code", "year").agg(F.sum("q_d08").alias("v"))
    sust = lp.groupBy(rgn("s_nationkey").alias("rgn_id"), "species_code").agg((1 - _ratio(F.sum("d"), F.sum("n")) * 5).alias("v"))
    species = t.part.select(_brand_no().alias("species_code"), F.col("p_brand").alias("species")).distinct()
    return (
        to_long(tonnes, "mar_harvest_tonnes", id_num="rgn_id", category="species_code", year="year", val_num="v")
        .unionByName(to_long(sust, "mar_sustainability_score", id_num="rgn_id", category="species_code", val_num="v"))
        .unionByName(to_long(species, "mar_harvest_species", category="species_code", val_chr="species"))
    )


def fam_fis(t: Tables) -> DataFrame:
    nat = t.nation.select("n_nationkey", (F.col("n_regionkey") + 1).alias("fao_id"))
    b = _brand_no()
    name = F.regexp_replace("p_brand", "#", "")
    key = ((F.lit(1) + b % 6) * 100000 + b).cast("int")
    p = t.part.select("p_partkey", F.concat_ws("_", name, key.cast("string")).alias("taxon"))
    s = t.supplier.select("s_suppkey", "s_nationkey")
    catch = (
        t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "taxon", year_of("l_shipdate").alias("year"))
        .agg(F.sum("l_quantity").alias("v"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("fao_saup_id", F.concat_ws("_", F.col("fao_id").cast("string"), F.col("l_suppkey").cast("string")))
    )
    lt = _line_type(t).where(F.col("l_returnflag") == "R").join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
    bmsy = lt.groupBy("fao_id", name.alias("taxon_name"), "year").agg((_ratio(F.sum("d"), F.sum("n")) * 20 + 0.5).alias("v"))
    prop = share_by_join(t.supplier.select("s_suppkey", "s_nationkey", (F.col("s_acctbal") + 1000).alias("x")), "x", "s_nationkey", "v").select(
        F.col("s_suppkey").alias("saup_id"), rgn("s_nationkey").cast("string").alias("rgn_id"), "v"
    )
    return (
        to_long(catch, "fis_meancatch", id_chr="fao_saup_id", category="taxon", year="year", val_num="v")
        .unionByName(to_long(bmsy, "fis_b_bmsy", id_num="fao_id", category="taxon_name", year="year", val_num="v"))
        .unionByName(to_long(prop, "fis_proparea_saup2rgn", id_num="saup_id", category="rgn_id", val_num="v"))
    )


def fam_ico(t: Tables) -> DataFrame:
    """Both layers from one aggregation: a species' few flag groups travel as an array beside its totals."""
    cats = F.create_map(*[F.lit(x) for kv in {2: "LC", 3: "NT", 4: "VU", 5: "EN", 6: "CR", 7: "EX"}.items() for x in kv])
    # integer cents keep the category boundaries exact whatever the summation order
    g = (
        _line_parts(t, "p_name")
        .groupBy("s_nationkey", "p_name", "l_returnflag")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("l_discount") * 100).cast("int")).alias("d_c"),
            F.sum(F.round(F.col("l_tax") * 100).cast("int")).alias("tax_c"),
        )
        .groupBy("s_nationkey", "p_name")
        .agg(F.collect_list(F.floor(F.coalesce(F.col("d_c") / F.col("n"), F.lit(0.0))).cast("int")).alias("d"), F.sum("tax_c").alias("tax_c"), F.sum("n").alias("n"))
    )
    tax2, n = F.col("tax_c") * 2, F.col("n")
    trend = F.when(tax2 < n * 7, "decreasing").when(tax2 < n * 9, "stable").otherwise("increasing")

    def row(layer: str, cat: Column) -> Column:
        return F.struct(F.lit(layer).alias("layer"), cat.alias("cat"))

    status = F.transform("d", lambda d: row("ico_spp_extinction_status", F.coalesce(F.element_at(cats, d), F.lit("DD"))))
    both = F.explode(F.concat(status, F.array(row("ico_spp_popn_trend", trend))))
    out = g.select(rgn("s_nationkey").alias("rgn_id"), F.col("p_name").alias("sciname"), both.alias("r"))
    return to_long(out, F.col("r.layer"), id_num="rgn_id", category="sciname", val_chr=F.col("r.cat"))


def fam_static(t: Tables) -> DataFrame:
    n = t.nation
    labels = to_long(n, "rgn_labels", id_num=rgn("n_nationkey"), category=F.lit("eez"), val_chr="n_name")
    glob = to_long(n, "rgn_global", id_num=rgn("n_nationkey"), val_chr="n_name")
    cr = to_long(n, "cntry_rgn", id_num=rgn("n_nationkey"), id_chr="n_name")
    geo = n.select(
        rgn("n_nationkey").alias("rgn_id"),
        F.explode(
            F.array(
                F.struct(F.lit("r0").alias("level"), F.lit(1).alias("g")),
                F.struct(F.lit("r1").alias("level"), F.when(F.col("n_regionkey") <= 1, 10).otherwise(20).alias("g")),
                F.struct(F.lit("r2").alias("level"), (F.col("n_regionkey") + 100).alias("g")),
            )
        ).alias("s"),
    )
    georegions = to_long(geo, "rgn_georegions", id_num="rgn_id", category=F.col("s.level"), val_num=F.col("s.g"))
    spark = t.spark
    tw = to_long(spark.createDataFrame(TRAVEL_WARNINGS, "rgn_name string, multiplier double"), "tr_travelwarnings",
                 id_chr="rgn_name", val_num="multiplier")
    return labels.unionByName(glob).unionByName(cr).unionByName(georegions).unionByName(tw)


FAMILIES: dict[str, tuple[Callable[[Tables], DataFrame], tuple[str, ...]]] = {
    "line_nation": (fam_line_nation, (
        "po_pathogens", "po_nutrients_3nm", "po_chemicals_3nm", "po_trash", "cw_pesticide_trend", "cw_fertilizer_trend",
        "cw_coastalpopn_trend", "cw_pathogen_trend", "tr_sustainability", "fp_wildcaught_weight", "np_blast", "np_cyanide")),
    "order_nation": (fam_order_nation, ("spp_status", "spp_trend", "ao_access", "rgn_area_inland1km", "rgn_area_offshore3nm", "rgn_area")),
    "order_nation_year": (fam_order_nation_year, (
        "ao_need", "tr_jobs_tourism", "tr_jobs_pct_tourism", "tr_unemployment", "tr_jobs_total", "le_popn",
        "mar_coastalpopn_inland25mi", "lsp_prot_area_inland1km", "lsp_prot_area_offshore3nm", "le_gdp_pc_ppp",
        "le_workforcesize_adj", "le_revenue_adj", "le_unemployment", "le_gdp")),
    "order_nation_sector": (fam_order_nation_sector, tuple(
        [f"le_{m}_{p}_{k}_value" for m in ("jobs", "rev", "wage") for p in ("cur", "ref") for k in ("base", "adj")]
        + ["le_jobs_sector_year", "le_rev_sector_year", "le_wage_sector_year"])),
    "line_nation_type": (fam_line_nation_type, ("hab_health", "hab_trend", "hab_extent", "np_harvest_product_weight")),
    "np_harvest": (fam_np_harvest, ("np_harvest_tonnes", "np_harvest_tonnes_relative")),
    "mar": (fam_mar, ("mar_harvest_tonnes", "mar_sustainability_score", "mar_harvest_species")),
    "fis": (fam_fis, ("fis_meancatch", "fis_b_bmsy", "fis_proparea_saup2rgn")),
    "ico": (fam_ico, ("ico_spp_extinction_status", "ico_spp_popn_trend")),
    "static": (fam_static, ("rgn_labels", "rgn_global", "cntry_rgn", "rgn_georegions", "tr_travelwarnings")),
}


def proxy_store(t: Tables, layers: Iterable[str] | None = None) -> LayerStore:
    """The proxy store, restricted to ``layers`` (only the families that produce them are planned)."""
    wanted = set(layers) if layers is not None else None
    parts = []
    for fn, names in FAMILIES.values():
        if wanted is None or wanted & set(names):
            df = fn(t)
            if wanted is not None:
                df = df.where(F.col("layer").isin(sorted(wanted & set(names))))
            parts.append(df)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return LayerStore(out.select(*LONG_COLUMNS))
