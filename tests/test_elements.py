"""Element weights from layers, and matrices that cover all leaf goals."""

from indexspark.plans import elements, extension_queries as XQ, extensions
from indexspark.plans.scenario import LEAF_JOBS
from indexspark.sources.layers import LONG_SCHEMA, LayerStore


def _store(spark):
    def row(layer, rgn=None, chr_=None, category=None, value=None):
        return (layer, rgn, chr_, category, None, value, None)

    rows = [
        row("hab_extent", 1, category="mangrove", value=2.0), row("hab_extent", 1, category="seagrass", value=3.0),
        row("hab_extent", 1, category="mangrove_inland1km", value=0.5), row("hab_extent", 1, category="mangrove_offshore", value=1.0),
        row("hab_extent", 1, category="coral", value=0.0), row("hab_extent", 2, category="coral", value=4.0),
        row("hab_extent", 2, category="saltmarsh"), row("hab_extent", 2, category="rocky_reef", value=9.0),
        row("np_harvest_product_weight", 1, category="shells", value=0.25), row("np_harvest_product_weight", 1, category="corals"),
        row("le_sector_weight", 1, category="tour", value=1.0), row("le_sector_weight", 2, category="tour", value=0.0),
        row("le_jobs_cur_base_value", chr_="AA", category="cf", value=5.0), row("le_jobs_cur_base_value", chr_="AB", category="cf", value=7.0),
        row("le_jobs_cur_base_value", chr_="ZZ", category="cf", value=9.0),
        row("cntry_rgn", 1, chr_="AA"), row("cntry_rgn", 1, chr_="AB"),
    ]
    return LayerStore(spark.createDataFrame(rows, LONG_SCHEMA))


def _rows(df):
    return {(r.goal, r.element, r.region_id): r.weight for r in df.collect()}


def test_weights_by_goal(spark):
    got = _rows(elements.element_weights(_store(spark)))
    assert got == {
        ("CS", "mangrove", 1): 278.0, ("CS", "seagrass", 1): 249.0,
        ("CP", "mangrove", 1): 6.0, ("CP", "seagrass", 1): 3.0, ("CP", "coral", 2): 16.0,  # mangroves: inland and offshore
        ("HAB", "mangrove", 1): 1.0, ("HAB", "seagrass", 1): 1.0, ("HAB", "coral", 2): 1.0,
        ("NP", "shells", 1): 0.25, ("LIV", "tour", 1): 1.0, ("ECO", "tour", 1): 1.0,
    }


def test_sectors_by_jobs_of_their_countries(spark):
    store = _store(spark)
    got = _rows(elements.element_weights(store, elements.sector_jobs(store)))
    assert {k: v for k, v in got.items() if k[0] in ("LIV", "ECO")} == {("LIV", "cf", 1): 12.0, ("ECO", "cf", 1): 12.0}


def test_no_layers_no_weights(spark):
    assert elements.element_weights(LayerStore(spark.createDataFrame([], LONG_SCHEMA))).collect() == []


def test_goal_weighted_in_one_matrix_only(spark):
    """A goal whose sectors have weights, in a matrix that names no element of it, is scored as a whole."""
    rm = spark.createDataFrame([("LIV", None, "a")], "goal string, element string, layer string")
    rc = spark.createDataFrame([("a", "social", 1.0)], "layer string, category_type string, weight double")
    vals = spark.createDataFrame([(1, "a", 0.5)], "region_id int, layer string, value double")
    weights = spark.createDataFrame([("LIV", "tour", 1, 1.0)], "goal string, element string, region_id int, weight double")
    assert [r.score for r in extensions.resilience(["LIV"], rm, rc, vals, element_weights=weights).collect()] == [50.0]


def test_matrices_cover_all_leaf_goals():
    assert {m[0] for m in XQ.PRESSURE_MATRIX} == set(LEAF_JOBS) == {m[0] for m in XQ.RESILIENCE_MATRIX}
    assert {m[0] for m in XQ.PRESSURE_MATRIX if m[1]} == {"CP", "CS", "HAB", "NP", "LIV", "ECO"}
