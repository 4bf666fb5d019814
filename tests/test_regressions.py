"""Caps and shared state that once dropped or mixed up data."""

import pytest
from pyspark.sql import functions as F

from indexspark.operators import filters, windows
from indexspark.operators import reshape as R
from indexspark.plans import composite, extensions, liveco, metadata, scenario
from indexspark.sources.layers import LayerStore, _decoded, catalog_frame, layer_target_bridge
from indexspark.sources.proxy import proxy_store
from indexspark.sources.tables import Tables


def _store(spark, rows):
    schema = "layer string, id_num long, id_chr string, category string, year int, val_num double, val_chr string"
    return LayerStore(spark.createDataFrame(rows, schema))


def test_every_target_is_kept(spark):
    df = spark.createDataFrame([("l", "A B C D  E")], "layer string, targets string")
    assert [r.t for r in R.explode_targets(df, "targets", "t").orderBy("t").collect()] == ["A", "B", "C", "D", "E"]
    assert [r.t for r in R.explode_targets(df, "targets", "t", max_parts=2).orderBy("t").collect()] == ["A", "B"]


def test_no_cap_on_a_dimension(spark):
    df = spark.range(12_000).select(F.lit(1).alias("k"), F.col("id").alias("y"), F.lit(1.0).alias("v")).unionAll(spark.createDataFrame([(2, 5, 2.0)], "k int, y long, v double"))
    out = R.complete_series(df, ["k"], "y")
    assert (out.count(), out.where("k = 2 and v is not null").count()) == (24_000, 1)


def test_no_cap_on_regions(spark):
    rows = [("rgn_global", i, None, None, None, None, "Antarctica" if i == 7 else f"r{i}") for i in range(1, 10_500)]
    scores = spark.range(0, 11_000).select(F.col("id").cast("int").alias("region_id"), F.lit("G").alias("goal"), F.lit("status").alias("dimension"), F.lit(1.0).alias("score"))
    out = composite.pre_global(_store(spark, rows), scores)
    assert out.columns == scores.columns and out.count() == 10_500
    assert [r.region_id for r in out.where("score is null").collect()] == [7] and out.where("region_id = 0").count() == 1


def test_each_store_keeps_its_own_pair(spark, monkeypatch):
    monkeypatch.setattr(scenario, "liv_eco_pair", lambda layers, *args: {"LIV": (id(layers), args)})
    params = {"liv_workforcesize_year": 2012, "eco_rev_adj_min_year": 2000}
    for _ in range(3):
        store = _store(spark, [("l", 1, None, None, None, 1.0, None)])
        assert scenario._pair(store, params)["LIV"][0] == id(store) and scenario._pair(store, params) is scenario._pair(store, params)
        assert len(store.pairs) == 1


def test_file_names_are_decoded(spark):
    df = spark.createDataFrame([("file:///x/a%20b+c.csv",)], "p string")
    assert df.select(_decoded(F.col("p"))).first()[0] == "file:///x/a b+c.csv"


def test_every_target_reaches_the_bridge(spark):
    bridge = layer_target_bridge(catalog_frame(spark, [dict(layer="l", targets="A B C D")]))
    assert sorted(r.target for r in bridge.collect()) == ["A", "B", "C", "D"]


def test_top_n_over_raw_rows_keeps_the_ranks_of_the_window(spark):
    rows = [("a", y, i) for i, y in enumerate([3, 3, 2, 1, None])] + [("b", y, i) for i, y in enumerate([5, 4, 4, 3])] + [(None, 1, 0)]
    df = spark.createDataFrame(rows, "k string, y int, i int")
    window = df.where(F.col("i") >= 0).withColumn("keep", windows.top_n_ties("y", "k", 2)).where("keep").drop("keep")
    assert sorted(map(str, windows.keep_top_n_ties(df, "y", "k", 2).collect())) == sorted(map(str, window.collect()))


def test_share_by_join(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0), ("c", None)], "k string, x double")
    got = {(r.k, r.x): r.s for r in windows.share_by_join(df, "x", "k", "s").collect()}
    assert got == {("a", 1.0): 0.25, ("a", 3.0): 0.75, ("b", 0.0): None, ("c", None): None}


def test_double_membership_is_of_each_column(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y"), (3, "z"), (None, "x"), (1, None), (1, "y")], "y int, s string")
    ref = spark.createDataFrame([(1, "x"), (2, "y"), (None, None)], "y int, s string")
    out = filters.double_membership_exclude(df, ref, [("y", "y"), ("s", "s")])
    assert sorted(map(str, out.collect())) == sorted(map(str, df.where("y = 3 or y is null or s is null").collect()))


def test_elements_are_scored_apart_and_weighted(spark):
    matrix = spark.createDataFrame([("CS", "a", "po", 2.0), ("CS", "b", "po", 2.0), ("CS", "b", "hd", 3.0), ("CW", None, "po", 3.0)],
                                   "goal string, element string, layer string, weight double")
    cats = spark.createDataFrame([("po", "ecological", "p"), ("hd", "ecological", "p")], "layer string, category string, subcategory string")
    vals = spark.createDataFrame([(1, "po", 0.6), (1, "hd", 0.2)], "region_id int, layer string, value double")
    weights = spark.createDataFrame([("CS", "a", 1, 3.0), ("CS", "b", 1, 1.0)], "goal string, element string, region_id int, weight double")

    def run(w=None):
        return {r.goal: round(r.score, 6) for r in extensions.pressures(["CS", "CW"], matrix, cats, vals, element_weights=w).collect()}

    assert run() == {"CS": 50.0, "CW": 60.0}  # a: 1.2 / 3, b: 1.8 / 3
    assert run(weights) == {"CS": 45.0, "CW": 60.0}
    rc = spark.createDataFrame([("po", "ecological", 1.0), ("hd", "social", 1.0)], "layer string, category_type string, weight double")
    r = extensions.resilience(["CS", "CW"], matrix, rc, vals, element_weights=weights).collect()
    assert {x.goal: round(x.score, 6) for x in r} == {"CS": round((3 * 60 + 40) / 4, 6), "CW": 60.0}


def test_unmatched_country_keys_stop_the_run(spark):
    store = proxy_store(Tables(spark, "/root/testdata/sf0.001"), metadata.GOAL_LAYERS["LIV"])
    lost = LayerStore(store.df.where(~((F.col("layer") == "cntry_rgn") & (F.col("id_chr") == "NATION_3"))))
    params = metadata.PROXY_PARAMS["LIV"] | {"fail_on_unmatched": True}
    with pytest.raises(Exception, match="country"):
        scenario._pair(lost, params)
    fixed = params | {"fixes": liveco.CountryFixes(extra_rows=[(4, "NATION_3", "NATION_3")])}
    assert scenario._pair(lost, fixed)["LIV"].scores.where("region_id = 4 and score is not null").count() > 0


def test_global_parameters_carry_the_lookup_repairs():
    for goal in ("LIV", "ECO"):
        assert scenario.GLOBAL_PARAMS[goal]["fixes"] is liveco.GLOBAL_FIXES and scenario.GLOBAL_PARAMS[goal]["fail_on_unmatched"]
