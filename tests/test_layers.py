"""Layer store: catalog-driven CSV ingest with the file quirks of real layer files, selection operators, snapshot."""

import os
import tempfile

from pyspark.sql import functions as F

from indexspark.sources.layers import LayerStore, catalog_frame, ingest_catalog, layer_target_bridge, to_long


def _write(d, name, data: bytes):
    with open(os.path.join(d, name), "wb") as fh:
        fh.write(data)


def _fixture_dir():
    d = tempfile.mkdtemp(prefix="indexspark-layers-")
    _write(d, "po_a.csv", b"rgn_id,pressure_score\r1,0.2\r2,\r3,0.5\r")  # CR-only line ends, an empty cell
    _write(d, "po_g.csv", b"rgn_id,pressure_score\n1,0.9\n4,0.1\n")  # same header shape, LF
    _write(d, "area_b.csv", b"rgn_id,area_km2\r\n1,10.5\r\n2,NA\r\n")  # CRLF, NA token
    _write(d, "prop_c.csv", b'saup_id,rgn_id,prop_area\n"1","NA","0.5"\n"2","3","1"\n')  # quoted numbers and NA
    _write(d, "res_d.csv", b"rgn_id,resilience.score\n1,0.7\n2,0.9\n")  # dotted column name
    _write(d, "hab_e.csv", b"rgn_id,habitat,health\n1,coral,0.8\n1,NAM,0.5\n")
    _write(d, "le_f.csv", b"cntry_key,sector,year,value\nNAM,tour,2010,5\nUSA,tour,2011,NA\n")  # NAM is a key, not NA
    return d


CATALOG = [
    dict(layer="po_a", targets="CW pressures", filename="po_a.csv", fld_id_num="rgn_id", fld_val_num="pressure_score"),
    dict(layer="po_g", targets="CW", filename="po_g.csv", fld_id_num="rgn_id", fld_val_num="pressure_score"),
    dict(layer="area_b", targets="spatial", filename="area_b.csv", fld_id_num="rgn_id", fld_val_num="area_km2"),
    dict(layer="prop_c", targets="FIS", filename="prop_c.csv", fld_id_num="saup_id", fld_category="rgn_id", fld_val_num="prop_area"),
    dict(layer="res_d", targets="resilience", filename="res_d.csv", fld_id_num="rgn_id", fld_val_num="resilience.score"),
    dict(layer="hab_e", targets="HAB CS CP", filename="hab_e.csv", fld_id_num="rgn_id", fld_category="habitat", fld_val_num="health"),
    dict(layer="le_f", targets="LIV ECO", filename="le_f.csv", fld_id_chr="cntry_key", fld_category="sector", fld_year="year",
         fld_val_num="value"),
]


def _store(spark):
    return ingest_catalog(spark, catalog_frame(spark, CATALOG), _fixture_dir())


def test_ingest_quirks(spark):
    st = _store(spark)
    got = {(r.layer, r.id_num, r.id_chr, r.category, r.year, r.val_num) for r in st.df.collect()}
    assert ("po_a", 1, None, None, None, 0.2) in got
    assert ("po_a", 2, None, None, None, None) in got  # empty cell
    assert ("po_a", 3, None, None, None, 0.5) in got  # CR-only file read line by line
    assert ("po_g", 4, None, None, None, 0.1) in got
    assert ("area_b", 2, None, None, None, None) in got  # NA token
    assert ("prop_c", 1, None, None, None, 0.5) in got and ("prop_c", 2, None, "3", None, 1.0) in got  # quoted
    assert ("res_d", 2, None, None, None, 0.9) in got  # dotted name
    assert ("hab_e", 1, None, "coral", None, 0.8) in got
    assert ("le_f", None, "NAM", "tour", 2010, 5.0) in got and ("le_f", None, "USA", "tour", 2011, None) in got
    assert st.df.count() == 15


def test_select_by_target_alias(spark):
    st = _store(spark)
    bridge = layer_target_bridge(catalog_frame(spark, CATALOG))
    assert {r.layer for r in st.by_target("CW", bridge).select("layer").distinct().collect()} == {"po_a", "po_g"}
    assert {r.layer for r in st.by_target("CP", bridge).select("layer").distinct().collect()} == {"hab_e"}
    al = st.alias({"po_a": "status", "res_d": "trend"})
    assert {r.layer for r in al.select("layer").distinct().collect()} == {"status", "trend"}
    n = st.narrow("hab_e", id_num="rgn_id", category="habitat", val_num="health")
    assert n.columns == ["rgn_id", "habitat", "health"]


def test_snapshot_and_partition_pruning(spark):
    st = _store(spark)
    path = os.path.join(tempfile.mkdtemp(prefix="indexspark-snap-"), "store")
    built = []

    def build():
        built.append(1)
        return st

    s1 = LayerStore.snapshot(spark, path, build)
    s2 = LayerStore.snapshot(spark, path, build)
    assert built == [1]
    assert s2.df.count() == s1.df.count() == 15
    plan = s2.select("po_a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "layer" in plan


def test_to_long_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan"))], "rgn_id int, v double")
    r = to_long(df, "x", id_num="rgn_id", val_num="v").collect()[0]
    assert r.val_num is None and r.layer == "x"
    assert F is not None


def test_catalog_rule_and_csv_scoring(spark):
    from indexspark.plans.scenario import score_csv_layers
    from indexspark.sources.catalog import entry_from_header

    e = entry_from_header("hab_health", "hab_health.csv", ["rgn_id", "habitat", "health"])
    assert (e["fld_id_num"], e["fld_category"], e["fld_val_num"], e["targets"]) == ("rgn_id", "habitat", "health", "CS CP HAB")
    e = entry_from_header("le_wage_sector_year", "x.csv", ["cntry_key", "sector", "year", "value"])
    assert (e["fld_id_chr"], e["fld_category"], e["fld_year"], e["fld_val_num"]) == ("cntry_key", "sector", "year", "value")
    e = entry_from_header("fis_proparea_saup2rgn", "x.csv", ["saup_id", "rgn_id", "prop_area"])
    assert (e["fld_id_num"], e["fld_category"]) == ("saup_id", "rgn_id")
    d = tempfile.mkdtemp(prefix="indexspark-csv-scenario-")
    for lyr in ("po_pathogens", "po_nutrients_3nm", "po_chemicals_3nm", "po_trash"):
        _write(d, f"{lyr}.csv", b'"rgn_id","pressure_score"\n1,0.5\n2,NA\n')
    for lyr in ("cw_pesticide_trend", "cw_fertilizer_trend", "cw_coastalpopn_trend", "cw_pathogen_trend"):
        _write(d, f"{lyr}.csv", b'"rgn_id","trend"\r\n1,0.2\r\n2,-0.4\r\n')
    _write(d, "spp_status.csv", b'"rgn_id","score"\n1,0.81\n')
    _write(d, "spp_trend.csv", b'"rgn_id","score"\n1,0.01\n')
    res = score_csv_layers(spark, d, goals={"CW", "SPP"})
    got = {(r.goal, r.region_id, r.dimension): r.score for r in res.scores.collect()}
    assert abs(got[("CW", 1, "status")] - 50.0) < 1e-9 and got[("CW", 2, "status")] is None
    assert abs(got[("CW", 1, "trend")] + 0.2) < 1e-12 and abs(got[("CW", 2, "trend")] - 0.4) < 1e-12
    assert abs(got[("SPP", 1, "status")] - 81.0) < 1e-9
    _write(d, "rgn_global.csv", b'"rgn_id","label"\n1,Here\n2,There\n')
    res = score_csv_layers(spark, d, finalise=True)  # the goals whose layers are there: CW and SPP
    got = {(r.goal, r.region_id, r.dimension): r.score for r in res.scores.collect()}
    assert abs(got[("CW", 1, "status")] - 50.0) < 1e-2 and got[("FIS", 1, "status")] is None
    assert abs(got[("BD", 1, "status")] - 81.0) < 1e-2
