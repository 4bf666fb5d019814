"""Goal models and composites on hand-computed mini layer stores."""

import math

from pyspark.sql import functions as F

from indexspark.plans import composite as C
from indexspark.plans import goals as G
from indexspark.plans import metadata as M
from indexspark.sources.layers import LONG_SCHEMA, LayerStore


def store(spark, rows):
    full = [tuple(list(r) + [None] * (7 - len(r))) for r in rows]
    return LayerStore(spark.createDataFrame(full, LONG_SCHEMA))


def L(layer, id_num=None, id_chr=None, category=None, year=None, val_num=None, val_chr=None):
    return (layer, id_num, id_chr, category, year, val_num, val_chr)


def scores(df):
    return {(r.region_id, r.dimension): r.score for r in df.collect()}


def test_cw_geometric_mean_and_zero(spark):
    rows = []
    for lyr, vals in {"po_pathogens": (0.2, 1.0), "po_nutrients_3nm": (0.5, 0.1), "po_chemicals_3nm": (None, 0.1), "po_trash": (0.1, 0.1)}.items():
        rows += [L(lyr, 1, val_num=vals[0]), L(lyr, 2, val_num=vals[1])]
    rows += [L("cw_pesticide_trend", 1, val_num=0.1), L("cw_fertilizer_trend", 1, val_num=-0.3), L("cw_pathogen_trend", 2, val_num=None)]
    s = scores(G.cw(store(spark, rows)).scores)
    expect = math.exp((math.log(0.8) + math.log(0.5) + math.log(0.9)) / 3) * 100
    assert abs(s[(1, "status")] - expect) < 1e-9
    assert s[(2, "status")] == 0.0  # a pressure of 1 gives a zero factor
    assert abs(s[(1, "trend")] - 0.1) < 1e-12 and s[(2, "trend")] is None


def test_spp_pass_through(spark):
    s = scores(G.spp(store(spark, [L("spp_status", 1, val_num=0.5), L("spp_trend", 1, val_num=-0.1)])).scores)
    assert s == {(1, "status"): 50.0, (1, "trend"): -0.1}


def _hab_rows():
    return [
        L("hab_health", 1, category="coral", val_num=0.8), L("hab_trend", 1, category="coral", val_num=0.1),
        L("hab_extent", 1, category="coral", val_num=10.0),
        L("hab_health", 1, category="mangrove", val_num=1.2), L("hab_trend", 1, category="mangrove", val_num=-0.2),
        L("hab_extent", 1, category="mangrove", val_num=0.0),
        L("hab_health", 1, category="seagrass", val_num=0.6), L("hab_extent", 1, category="seagrass", val_num=5.0),
        L("hab_extent", 1, category="mangrove_inland1km", val_num=2.0), L("hab_extent", 1, category="mangrove_offshore", val_num=3.0),
        L("hab_health", 2, category="saltmarsh", val_num=1.5), L("hab_extent", 2, category="saltmarsh", val_num=1.0),
    ]


def test_hab_gate_and_cap(spark):
    s = scores(G.hab(store(spark, _hab_rows())).scores)
    assert abs(s[(1, "status")] - 70.0) < 1e-9  # mangrove has no extent: gated out
    assert abs(s[(1, "trend")] - 0.1) < 1e-12
    assert s[(2, "status")] == 100.0  # capped


def test_cs_and_cp_ranks(spark):
    st = store(spark, _hab_rows())
    cs = G.cs(st)
    s = scores(cs.scores)
    assert abs(s[(1, "status")] - 60.0) < 1e-9  # only seagrass counts (mangrove extent 0 -> NA)
    contrib = {(r.rgn_id, r.habitat): r.prop_score for r in cs.diagnostics["cs_hab_contributions"].collect()}
    assert contrib == {(1, "seagrass"): 1.0, (2, "saltmarsh"): 1.0}
    cp = scores(G.cp(st).scores)
    # coral 4*0.8*10 + mangrove(2+3) 4*1.2*5 + seagrass 1*0.6*5 over 4*10 + 4*5 + 1*5, capped at 1
    expect = min(1.0, (32 + 24 + 3) / 65) * 100
    assert abs(cp[(1, "status")] - expect) < 1e-9


def test_fis_small(spark):
    rows = [
        L("fis_meancatch", id_chr="1_7", category="A_600001", year=2011, val_num=30.0),
        L("fis_meancatch", id_chr="1_7", category="B_100002", year=2011, val_num=10.0),
        L("fis_meancatch", id_chr="1_7", category="A_600001", year=2010, val_num=30.0),
        L("fis_meancatch", id_chr="1_7", category="B_100002", year=2010, val_num=10.0),
        L("fis_b_bmsy", 1, category="A", year=2011, val_num=0.5),
        L("fis_b_bmsy", 1, category="A", year=2010, val_num=0.5),
        L("fis_proparea_saup2rgn", 7, category="3", val_num=1.0),
    ]
    s = scores(G.fis(store(spark, rows), 2011).scores)
    raw = 0.5 ** 0.75 * 0.005 ** 0.25
    assert s[(3, "status")] == round(raw * 100)
    assert s[(3, "trend")] == 0.0


def test_ao_trend_top5(spark):
    rows = [L("ao_access", 1, val_num=0.5)] + [L("ao_need", 1, year=y, val_num=0.1 * (y - 2005)) for y in range(2006, 2014)]
    s = scores(G.ao(store(spark, rows), 2013).scores)
    assert abs(s[(1, "status")] - (1 - (1 - 0.8) * 0.5) * 100) < 1e-9
    assert abs(s[(1, "trend")] - 0.05 * 5) < 1e-9  # slope of statusData = 0.5*0.1 per year


def _scores_df(spark, rows):
    return spark.createDataFrame(rows, G.SCORES_SCHEMA)


def test_composites(spark):
    s = _scores_df(spark, [
        (1, "FIS", "status", 40.0), (1, "MAR", "status", 80.0), (1, "HAB", "status", 50.0), (1, "SPP", "status", None),
        (1, "ICO", "trend", 0.2), (1, "LSP", "trend", None), (1, "FIS", "pressures", 10.0),
    ])
    st = store(spark, [L("fp_wildcaught_weight", 1, val_num=0.75)])
    fp, _ = C.fp(st, s)
    assert scores(fp.where("goal = 'FP'")) == {(1, "status"): 50.0}
    assert scores(C.bd(s).where("goal = 'BD'")) == {(1, "status"): 50.0}
    assert scores(C.sp(s).where("goal = 'SP'")) == {(1, "trend"): 0.2}


def test_finalize_grid_size(spark):
    st = store(spark, [L("rgn_global", i, val_chr=f"r{i}") for i in (1, 2, 3)])
    out = C.finalize(st, _scores_df(spark, [(1, "CW", "status", 12.345)]))
    assert out.count() == 4 * 6 * 19 - 3 * 19 - 4 * 4 + 3
    assert out.where("goal = 'CW' AND dimension = 'status' AND region_id = 1").collect()[0].score == 12.34


def test_pre_global(spark):
    st = store(spark, [L("rgn_global", 1, val_chr="Antarctica"), L("rgn_global", 2, val_chr="B")])
    s = _scores_df(spark, [(1, "CW", "status", 1.0), (2, "CW", "status", 2.0), (0, "CW", "status", 3.0), (9, "CW", "status", 4.0)])
    got = scores(C.pre_global(st, s))
    assert got == {(1, "status"): None, (2, "status"): 2.0, (0, "status"): 3.0}


def test_goal_table():
    roots = [g for g in M.GOALS if g[4] is None]
    assert len(M.GOALS) == 18 and len(roots) == 10 and sum(g[6] for g in roots) == 10.0
    assert F is not None


def test_quality_reports(spark):
    from indexspark.plans.quality import dimension_range_violations, duplicate_keys, fail_if_any, unknown_dimensions

    s = _scores_df(spark, [(1, "CW", "status", 101.0), (1, "CW", "trend", -0.5), (2, "CW", "trend", 1.5),
                           (2, "CW", "status", None), (2, "CW", "status", 3.0), (3, "CW", "bogus", 1.0)])
    assert {(r.region_id, r.dimension) for r in dimension_range_violations(s).collect()} == {(1, "status"), (2, "trend")}
    assert unknown_dimensions(s).count() == 1 and duplicate_keys(s).count() == 1
    try:
        fail_if_any(dimension_range_violations(s), "out of range")
        raise AssertionError("expected a failure")
    except ValueError as e:
        assert "out of range" in str(e)
