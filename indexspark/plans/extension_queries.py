"""Extension queries (X1-X7) on the proxy layers: gap fill by georegion, pressures, resilience, likely future, goal
score, Index and the area-weighted global region. The matrices are small literal tables of the scenario and cover all
leaf goals, with elements weighted by what the layers hold (``elements.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..session import stored
from ..sources.layers import LayerStore
from ..sources.proxy import proxy_store
from ..sources.tables import Tables, nation_year_revenue
from . import composite as C
from . import elements as E
from . import extensions as X
from . import goal_oracles as GO
from . import goals as G
from . import metadata as M
from . import proxy_sql as Q
from .goal_queries import rounded
from .registry import register
from .scenario import LEAF_JOBS, run_leaf_goals

# fixed values: proxy pressure layers with their categories
PRESSURE_CATEGORIES = [
    ("po_pathogens", "ecological", "pollution"), ("po_nutrients_3nm", "ecological", "pollution"),
    ("po_chemicals_3nm", "ecological", "pollution"), ("po_trash", "ecological", "habitat_destruction"),
    ("np_blast", "ecological", "habitat_destruction"), ("np_cyanide", "ecological", "fishing_pressure"),
    ("ao_access", "social", "social"),
]
# fixed values: proxy pressure matrix: goals, element, and the weights (0 to 3) of the layers in the order above
PRESSURE_WEIGHTS = [
    ("CW", "", (3, 3, 2, 1, 0, 0, 1)), ("SPP", "", (0, 0, 2, 2, 1, 1, 1)), ("AO", "", (0, 1, 1, 0, 3, 2, 1)),
    ("FIS", "", (0, 1, 1, 1, 2, 3, 1)), ("MAR", "", (0, 3, 2, 0, 0, 0, 1)), ("TR", "", (3, 0, 3, 3, 0, 0, 1)),
    ("ICO", "", (0, 1, 3, 1, 2, 2, 1)), ("LSP", "", (0, 2, 2, 3, 2, 0, 1)),
    ("CP CS HAB", "mangrove", (0, 1, 1, 3, 0, 0, 1)), ("CP CS HAB", "saltmarsh", (0, 2, 1, 3, 0, 0, 1)),
    ("CP CS HAB", "seagrass", (0, 3, 2, 3, 1, 0, 1)), ("CP HAB", "coral", (1, 2, 1, 1, 3, 3, 2)),
    ("HAB", "soft_bottom", (0, 2, 2, 1, 3, 1, 1)),
    ("NP", "corals", (0, 2, 1, 0, 3, 1, 1)), ("NP", "fish_oil", (0, 1, 2, 0, 2, 2, 1)), ("NP", "ornamentals", (0, 1, 2, 0, 3, 3, 1)),
    ("NP", "seaweeds", (0, 2, 2, 0, 1, 0, 1)), ("NP", "shells", (0, 1, 0, 1, 2, 0, 1)), ("NP", "sponges", (0, 1, 0, 2, 3, 1, 1)),
    ("LIV ECO", "AUTOMOBILE", (0, 0, 3, 2, 0, 0, 1)), ("LIV ECO", "BUILDING", (0, 0, 2, 3, 1, 0, 1)),
    ("LIV ECO", "FURNITURE", (0, 1, 2, 1, 0, 1, 1)), ("LIV ECO", "HOUSEHOLD", (3, 2, 1, 3, 0, 0, 1)),
    ("LIV ECO", "MACHINERY", (0, 0, 3, 1, 0, 0, 1)),
]
PRESSURE_MATRIX = [
    (goal, element, layer, float(weight))
    for goals, element, weights in PRESSURE_WEIGHTS for goal in goals.split()
    for (layer, *_), weight in zip(PRESSURE_CATEGORIES, weights, strict=True) if weight
]
# fixed values: proxy resilience layers with categories and weights
RESILIENCE_CATEGORIES = [("fp_wildcaught_weight", "ecological", 1.0), ("spp_status", "regulatory", 0.5), ("ao_access", "social", 1.0)]
# fixed values: proxy resilience matrix: goals, element, layers
RESILIENCE_MARKS = [
    ("CW FIS ICO", "", "fp_wildcaught_weight spp_status ao_access"), ("SPP", "", "fp_wildcaught_weight spp_status"),
    ("AO MAR LSP", "", "spp_status ao_access"), ("TR LIV ECO", "", "ao_access"),
    ("CP CS HAB", "mangrove", "spp_status ao_access"), ("CP CS HAB", "saltmarsh", "ao_access"),
    ("CP CS HAB", "seagrass", "fp_wildcaught_weight spp_status ao_access"), ("CP HAB", "coral", "fp_wildcaught_weight ao_access"),
    ("HAB", "soft_bottom", "fp_wildcaught_weight"),
    ("NP", "corals", "spp_status ao_access"), ("NP", "fish_oil", "fp_wildcaught_weight spp_status ao_access"),
    ("NP", "ornamentals", "spp_status"), ("NP", "seaweeds", "ao_access"), ("NP", "shells", "spp_status ao_access"),
    ("NP", "sponges", "fp_wildcaught_weight"),
]
RESILIENCE_MATRIX = [
    (goal, element, layer) for goals, element, layers in RESILIENCE_MARKS for goal in goals.split() for layer in layers.split()
]

EXT_GOALS = list(LEAF_JOBS)
VALUE_LAYERS = sorted({layer for layer, *_ in PRESSURE_CATEGORIES + RESILIENCE_CATEGORIES})


def _values_sql(rows, cols: str) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") v({cols})"


def matrices(spark) -> dict[str, DataFrame]:
    """The proxy matrices and categories, named as the arguments of ``ExtensionInputs``."""
    return dict(
        pressures_matrix=spark.createDataFrame(PRESSURE_MATRIX, "goal string, element string, layer string, weight double"),
        pressure_categories=spark.createDataFrame(PRESSURE_CATEGORIES, "layer string, category string, subcategory string"),
        resilience_matrix=spark.createDataFrame(RESILIENCE_MATRIX, "goal string, element string, layer string"),
        resilience_categories=spark.createDataFrame(RESILIENCE_CATEGORIES, "layer string, category_type string, weight double"),
    )


def layer_values(store: LayerStore) -> DataFrame:
    return store.select_many(VALUE_LAYERS).select(F.col("id_num").alias("region_id"), "layer", F.col("val_num").alias("value"))


def proxy_weights(store: LayerStore) -> DataFrame:
    """Element weights of the proxy layers; sectors weigh by their jobs."""
    return stored(E.element_weights(store, E.sector_jobs(store)), "element-weights")


def _pressures(spark, store):
    m = matrices(spark)
    return rounded(X.pressures(EXT_GOALS, m["pressures_matrix"], m["pressure_categories"], layer_values(store), element_weights=proxy_weights(store)))


def _resilience(spark, store):
    m = matrices(spark)
    return rounded(X.resilience(EXT_GOALS, m["resilience_matrix"], m["resilience_categories"], layer_values(store), element_weights=proxy_weights(store)))


def _element_store(spark, sf) -> LayerStore:
    return proxy_store(Tables(spark, sf), VALUE_LAYERS + E.ELEMENT_LAYERS + E.SECTOR_LAYERS).materialize()


def _rank_case(ranks) -> str:
    return "CASE habitat " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " END"


ELEMENTS_CTE = f"""ew AS (SELECT * FROM (
  SELECT 'CS' AS goal, habitat AS element, rgn_id AS region_id, km2 * {_rank_case(G.CS_RANKS)} AS weight FROM extx
  UNION ALL
  SELECT 'CP', habitat, rgn_id, km2 * {_rank_case(G.CP_RANKS)} FROM extx WHERE habitat <> 'mangrove'
  UNION ALL
  SELECT 'CP', 'mangrove', rgn_id, sum(km2) * {G.CP_RANKS['mangrove']} FROM extx WHERE habitat IN ('mangrove_inland1km', 'mangrove_offshore') GROUP BY rgn_id
  UNION ALL
  SELECT 'HAB', habitat, rgn_id, 1.0 FROM extx WHERE km2 > 0 AND habitat IN ({", ".join(repr(h) for h in G.HAB_HABITATS)})
  UNION ALL
  SELECT 'NP', product, rgn_id, rev / sum(rev) OVER (PARTITION BY rgn_id) FROM habx
  UNION ALL
  SELECT g.goal, c_mktsegment, c_nationkey + 1, CAST(count(*) AS DOUBLE) FROM ofx, (VALUES ('LIV'), ('ECO')) g(goal) WHERE year = 2000 GROUP BY 1, 2, 3)
  WHERE weight > 0)"""

VALS_SQL = f"""{Q.LN}, {Q.OF}, {Q.ON}, {Q.LP}, {Q.HAB},
vals AS (SELECT rgn_id AS region_id, layer, v AS value FROM
           (SELECT rgn_id, po_pathogens, po_nutrients_3nm, po_chemicals_3nm, po_trash, np_blast, np_cyanide, fp_wildcaught_weight FROM ln)
           UNPIVOT (v FOR layer IN (po_pathogens, po_nutrients_3nm, po_chemicals_3nm, po_trash, np_blast, np_cyanide, fp_wildcaught_weight))
         UNION ALL SELECT rgn_id, 'ao_access', ao_access FROM onx
         UNION ALL SELECT rgn_id, 'spp_status', spp_status FROM onx),
{ELEMENTS_CTE}"""


def _over_elements_sql(dimension: str) -> str:
    """Goal values from ``parts(goal, element, region_id, value)`` and the element weights ``ew``."""
    return f"""SELECT region_id, goal, '{dimension}' AS dimension,
       round(coalesce(sum(value * w) FILTER (WHERE value IS NOT NULL), 0) / NULLIF(sum(w) FILTER (WHERE value IS NOT NULL), 0) * 100, 6) AS score
FROM (SELECT parts.*, CASE WHEN parts.element = '' THEN 1.0 ELSE coalesce(ew.weight, 0.0) END AS w
      FROM parts LEFT JOIN ew ON ew.goal = parts.goal AND ew.element = parts.element AND ew.region_id = parts.region_id)
GROUP BY region_id, goal"""


PRESSURES_SQL = f"""WITH {VALS_SQL},
pm AS (SELECT * FROM {_values_sql(PRESSURE_MATRIX, 'goal, element, layer, weight')}),
pc AS (SELECT * FROM {_values_sql(PRESSURE_CATEGORIES, 'layer, category, subcategory')}),
j AS (SELECT pm.goal, pm.element, pm.layer, pm.weight, pc.category, pc.subcategory, vals.region_id, vals.value
      FROM pm JOIN pc ON pc.layer = pm.layer JOIN vals ON vals.layer = pm.layer),
e1 AS (SELECT goal, element, region_id, subcategory,
              CASE WHEN sum(weight * value) IS NULL THEN NULL ELSE least(1.0, sum(weight * value) / 3.0) END AS p_k,
              max(weight) AS w_k FROM j WHERE category = 'ecological' GROUP BY 1, 2, 3, 4),
eco AS (SELECT goal, element, region_id, sum(p_k * w_k) FILTER (WHERE p_k IS NOT NULL) / NULLIF(sum(w_k) FILTER (WHERE p_k IS NOT NULL), 0) AS p_e
        FROM e1 GROUP BY 1, 2, 3),
soc AS (SELECT goal, element, region_id, sum(value * weight) FILTER (WHERE value IS NOT NULL) / NULLIF(sum(weight) FILTER (WHERE value IS NOT NULL), 0) AS p_s
        FROM j WHERE category = 'social' GROUP BY 1, 2, 3),
parts AS (SELECT goal, element, region_id, CASE WHEN p_e IS NOT NULL AND p_s IS NOT NULL THEN 0.5 * p_e + 0.5 * p_s ELSE coalesce(p_e, p_s) END AS value
          FROM eco FULL JOIN soc USING (goal, element, region_id))
{_over_elements_sql('pressures')}"""

RESILIENCE_SQL = f"""WITH {VALS_SQL},
rm AS (SELECT DISTINCT * FROM {_values_sql(RESILIENCE_MATRIX, 'goal, element, layer')}),
rc AS (SELECT * FROM {_values_sql(RESILIENCE_CATEGORIES, 'layer, category_type, weight')}),
j AS (SELECT rm.goal, rm.element, rc.category_type, rc.weight, vals.region_id, vals.value
      FROM rm JOIN rc ON rc.layer = rm.layer JOIN vals ON vals.layer = rm.layer),
part AS (SELECT goal, element, region_id, category_type,
                sum(value * weight) FILTER (WHERE value IS NOT NULL) / NULLIF(sum(weight) FILTER (WHERE value IS NOT NULL), 0) AS v
         FROM j GROUP BY 1, 2, 3, 4),
w AS (SELECT goal, element, region_id, max(v) FILTER (WHERE category_type = 'ecological') AS eco,
             max(v) FILTER (WHERE category_type = 'regulatory') AS reg, max(v) FILTER (WHERE category_type = 'social') AS soc FROM part GROUP BY 1, 2, 3),
e AS (SELECT *, (coalesce(eco, 0) + coalesce(reg, 0)) / NULLIF((CASE WHEN eco IS NULL THEN 0 ELSE 1 END) + (CASE WHEN reg IS NULL THEN 0 ELSE 1 END), 0) AS ye FROM w),
parts AS (SELECT goal, element, region_id, CASE WHEN ye IS NOT NULL AND soc IS NOT NULL THEN 0.5 * ye + 0.5 * soc ELSE coalesce(ye, soc) END AS value FROM e)
{_over_elements_sql('resilience')}"""

FUTURE_CTES = f"""{GO.ORACLES_FINALIZE_PARTS['leaf_ctes']},
leaf0 AS ({GO.ORACLES_FINALIZE_PARTS['leaf_union']}),
s_p AS ({PRESSURES_SQL}), s_r AS ({RESILIENCE_SQL}),
allx AS (SELECT * FROM leaf0 UNION ALL SELECT * FROM s_p UNION ALL SELECT * FROM s_r),
wide AS (SELECT region_id, goal, max(score) FILTER (WHERE dimension = 'status') AS status, max(score) FILTER (WHERE dimension = 'trend') AS trend,
                max(score) FILTER (WHERE dimension = 'pressures') AS p, max(score) FILTER (WHERE dimension = 'resilience') AS r
         FROM allx GROUP BY 1, 2),
fut AS (SELECT region_id, goal, status,
          CASE WHEN status IS NULL THEN NULL ELSE greatest(0.0, least(100.0,
            (1 + 0.67 * coalesce(trend, 0.0) + (1 - 0.67) * (coalesce(r / 100, 0.0) - coalesce(p / 100, 0.0))) * status / 1.0)) END AS future
        FROM wide),
fs AS (SELECT region_id, goal, 'future' AS dimension, round(future, 6) AS score FROM fut
       UNION ALL
       SELECT region_id, goal, 'score', round((coalesce(status, 0) + coalesce(future, 0))
              / NULLIF((CASE WHEN status IS NULL THEN 0 ELSE 1 END) + (CASE WHEN future IS NULL THEN 0 ELSE 1 END), 0), 6) FROM fut)"""


def _future_and_score(spark, sf):
    """The proxy store, the leaf scores and the future and score rows; the leaf scores are written once."""
    store = proxy_store(Tables(spark, sf)).materialize()
    leaf = rounded(run_leaf_goals(store, M.PROXY_PARAMS).scores)
    leaf = stored(leaf.unionByName(_pressures(spark, store)).unionByName(_resilience(spark, store)), "goal-scores")
    return store, leaf, rounded(X.likely_future_and_score(leaf))


@register("element_weights", f"WITH {Q.OF}, {Q.LP}, {Q.HAB}, {ELEMENTS_CTE} SELECT goal, element, CAST(region_id AS INTEGER) AS region_id, weight FROM ew")
def q_element_weights(spark, sf):
    store = proxy_store(Tables(spark, sf), E.ELEMENT_LAYERS + E.SECTOR_LAYERS)
    return E.element_weights(store, E.sector_jobs(store))


@register("pressures", PRESSURES_SQL)
def q_pressures(spark, sf):
    return _pressures(spark, _element_store(spark, sf))


@register("resilience", RESILIENCE_SQL)
def q_resilience(spark, sf):
    return _resilience(spark, _element_store(spark, sf))


@register("likely_future", f"WITH {FUTURE_CTES} SELECT * FROM fs WHERE dimension = 'future'")
def q_likely_future(spark, sf):
    return _future_and_score(spark, sf)[2].where(F.col("dimension") == "future")


@register("goal_score", f"WITH {FUTURE_CTES} SELECT * FROM fs WHERE dimension = 'score'")
def q_goal_score(spark, sf):
    return _future_and_score(spark, sf)[2].where(F.col("dimension") == "score")


@register(
    "index_score",
    f"""WITH {FUTURE_CTES},
leaf AS (SELECT * FROM fs),
{GO.ORACLES_FINALIZE_PARTS['composites']},
roots AS (SELECT * FROM (VALUES {", ".join(f"('{g[3]}', {g[6]})" for g in M.GOALS if g[4] is None)}) v(goal, weight))
SELECT s5.region_id, 'Index' AS goal, s5.dimension,
       round(sum(s5.score * roots.weight) FILTER (WHERE s5.score IS NOT NULL)
             / NULLIF(sum(roots.weight) FILTER (WHERE s5.score IS NOT NULL), 0), 6) AS score
FROM s5 JOIN roots ON roots.goal = s5.goal GROUP BY s5.region_id, s5.dimension""",
)
def q_index_score(spark, sf):
    store, _, fs = _future_and_score(spark, sf)
    s, _ = C.fp(store, fs)
    s = C.bd(C.sp(C.le(store, s)))
    return rounded(X.index_score(s, M.goals_frame(spark)).select("region_id", "goal", "dimension", "score"))


@register(
    "area_weighted_global",
    f"""WITH {FUTURE_CTES},
x AS (SELECT * FROM allx UNION ALL SELECT * FROM fs),
area AS (WITH {Q.OF}, {Q.ON} SELECT rgn_id AS region_id, rgn_area AS area FROM onx)
SELECT 0 AS region_id, goal, dimension,
       round(sum(score * area) FILTER (WHERE score IS NOT NULL) / NULLIF(sum(area) FILTER (WHERE score IS NOT NULL), 0), 6) AS score
FROM x JOIN area USING (region_id) WHERE dimension IN ('status', 'future', 'score') GROUP BY goal, dimension""",
)
def q_area_weighted_global(spark, sf):
    store, leaf, fs = _future_and_score(spark, sf)
    areas = store.narrow("rgn_area", id_num="region_id", val_num="area")
    g = X.area_weighted_global(leaf.unionByName(fs), areas)
    return rounded(g.select(F.col("region_id").cast("int").alias("region_id"), "goal", "dimension", "score"))


# ---------------------------------------------------------------- X1 georegional gap fill

GAP_SQL = """d0 AS (SELECT c_nationkey + 1 AS rgn_id, avg(o_totalprice) / 1000 AS v, CAST(count(*) AS DOUBLE) AS w
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
d AS (SELECT rgn_id, CASE WHEN w >= (SELECT avg(w) FROM d0) THEN v END AS v, w FROM d0),
geo AS (SELECT n_nationkey + 1 AS rgn_id, 1 AS r0, CASE WHEN n_regionkey <= 1 THEN 10 ELSE 20 END AS r1, n_regionkey + 100 AS r2 FROM nation),
b AS (SELECT geo.*, d.v, d.w FROM geo LEFT JOIN d USING (rgn_id)),
m2 AS (SELECT r2, sum(v * w) / NULLIF(sum(w), 0) AS m_r2 FROM b WHERE v IS NOT NULL GROUP BY 1),
m1 AS (SELECT r1, sum(v * w) / NULLIF(sum(w), 0) AS m_r1 FROM b WHERE v IS NOT NULL GROUP BY 1)"""


@register(
    "gapfill_levels",
    f"""WITH {GAP_SQL}
SELECT rgn_id, round(coalesce(v, m_r2, m_r1), 6) AS score,
       CASE WHEN v IS NOT NULL THEN 'v' WHEN m_r2 IS NOT NULL THEN 'r2' WHEN m_r1 IS NOT NULL THEN 'r1' END AS z_level
FROM b LEFT JOIN m2 USING (r2) LEFT JOIN m1 USING (r1)""",
)
def q_gapfill_levels(spark, sf):
    t = Tables(spark, sf)
    ny = J.once(nation_year_revenue(t).groupBy((F.col("rgn_id") + 1).alias("rgn_id")).agg(F.sum("revenue").alias("revenue"), F.sum("n_orders").cast("double").alias("w")))
    # a region with fewer orders than the mean of the regions does not report: its value is the gap to fill
    reports = F.col("w") >= ny.agg(F.avg("w")).scalar()
    data = ny.select("rgn_id", F.when(reports, F.col("revenue") / F.col("w") / 1000).alias("score"), "w")
    geo = X.georegions_wide(proxy_store(t, ["rgn_georegions"]))
    g = X.gapfill_georegions(data, geo, "rgn_id", "score", "w", r0_to_na=True)
    return g.select("rgn_id", F.round("score", 6).alias("score"), "z_level")
