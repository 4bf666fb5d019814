"""Goal-job queries on the proxy layer store, with SQL oracles that restate each model over the same derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.layers import LayerStore
from ..sources.proxy import proxy_store
from ..sources.tables import Tables
from . import composite as C
from . import goals as G
from . import metadata as M
from . import proxy_sql as Q
from .registry import register
from .scenario import LEAF_JOBS, run_leaf_goals, run_scenario

GOAL_LAYERS = M.GOAL_LAYERS


def store_for(spark, sf: str, goals, materialize: bool = True) -> LayerStore:
    """The proxy layers the goals read; materialised once (reliable checkpoint) so that the many selections of one
    goal plan read stored layers instead of re-running the family aggregations."""
    wanted = sorted({lyr for g in goals for lyr in GOAL_LAYERS.get(g, [])})
    store = proxy_store(Tables(spark, sf), wanted)
    return store.materialize() if materialize else store


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("region_id", "goal", "dimension", F.round("score", digits).alias("score"))


def leaf_query(goal: str, needs=()):
    def run(spark, sf):
        store = store_for(spark, sf, [goal, *needs])
        res = run_leaf_goals(store, M.PROXY_PARAMS, only={goal, *needs})
        return rounded(res.scores.where(F.col("goal") == goal))

    return run


# ---------------------------------------------------------------- oracles of the leaf goals

CW_SQL = f"""WITH {Q.LN},
p AS (SELECT rgn_id, 1 - v AS x FROM ln UNPIVOT (v FOR layer IN (po_pathogens, po_nutrients_3nm, po_chemicals_3nm, po_trash))),
t AS (SELECT rgn_id, v FROM ln UNPIVOT (v FOR layer IN (cw_pesticide_trend, cw_fertilizer_trend, cw_coastalpopn_trend, cw_pathogen_trend)))
SELECT rgn_id AS region_id, 'CW' AS goal, 'status' AS dimension,
  round(CASE WHEN count(*) FILTER (WHERE x = 0) > 0 THEN 0.0 ELSE exp(avg(ln(x)) FILTER (WHERE x > 0)) END * 100, 6) AS score
FROM p GROUP BY 1
UNION ALL
SELECT rgn_id, 'CW', 'trend', round(avg(-v), 6) FROM t GROUP BY 1"""

SPP_SQL = f"""WITH {Q.OF}, {Q.ON}
SELECT rgn_id AS region_id, 'SPP' AS goal, 'status' AS dimension, round(spp_status * 100, 6) AS score FROM onx
UNION ALL SELECT rgn_id, 'SPP', 'trend', round(spp_trend, 6) FROM onx"""

HAB_SQL = f"""WITH {Q.LP}, {Q.HAB},
d AS (SELECT * FROM habx WHERE habitat IN ('coral', 'mangrove', 'saltmarsh', 'seaice_edge', 'seagrass', 'soft_bottom') AND km2 > 0)
SELECT rgn_id AS region_id, 'HAB' AS goal, 'status' AS dimension, round(least(1.0, sum(health) / count(*)) * 100, 6) AS score
FROM d WHERE health IS NOT NULL GROUP BY 1
UNION ALL
SELECT rgn_id, 'HAB', 'trend', round(sum(trend) / count(*), 6) FROM d WHERE trend IS NOT NULL GROUP BY 1"""


def _ranked_sql(goal: str, ranks: dict, extent_cte: str) -> str:
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items())
    names = ", ".join(f"'{k}'" for k in ranks)
    return f"""WITH {Q.LP}, {Q.HAB}, {extent_cte},
j AS (SELECT coalesce(x.rgn_id, h.rgn_id) AS rgn_id, coalesce(x.habitat, h.habitat) AS habitat, x.km2, h.health, h.trend
      FROM ex x FULL JOIN habx h ON x.rgn_id = h.rgn_id AND x.habitat = h.habitat),
d AS (SELECT rgn_id, habitat, NULLIF(km2, 0) AS extent, health, trend, CASE habitat {case} END AS rank FROM j WHERE habitat IN ({names}))
SELECT rgn_id AS region_id, '{goal}' AS goal, 'status' AS dimension,
  round(least(1.0, sum(rank * health * extent) / sum(extent * rank)) * 100, 6) AS score
FROM d WHERE rank IS NOT NULL AND health IS NOT NULL AND extent IS NOT NULL GROUP BY 1
UNION ALL
SELECT rgn_id, '{goal}', 'trend', round(sum(rank * trend * extent) / sum(extent * rank), 6)
FROM d WHERE rank IS NOT NULL AND trend IS NOT NULL AND extent IS NOT NULL GROUP BY 1"""


CS_SQL = _ranked_sql("CS", G.CS_RANKS, "ex AS (SELECT rgn_id, habitat, km2 FROM extx)")
CP_SQL = _ranked_sql(
    "CP",
    G.CP_RANKS,
    """ex AS (SELECT rgn_id, habitat, km2 FROM extx WHERE habitat NOT IN ('mangrove', 'mangrove_inland1km', 'mangrove_offshore')
  UNION ALL
  SELECT rgn_id, 'mangrove', coalesce(sum(km2), 0) FROM extx WHERE habitat IN ('mangrove_inland1km', 'mangrove_offshore') GROUP BY 1)""",
)

HAB_CONTRIB_SQL = f"""WITH {Q.LP}, {Q.HAB},
d AS (SELECT rgn_id, habitat, CASE habitat WHEN 'mangrove' THEN 139.0 WHEN 'saltmarsh' THEN 210.0 WHEN 'seagrass' THEN 83.0 END * NULLIF(km2, 0) AS wc
      FROM extx WHERE habitat IN ('mangrove', 'saltmarsh', 'seagrass'))
SELECT rgn_id, habitat, round_even(wc / sum(wc) OVER (PARTITION BY rgn_id), 3) AS prop_score FROM d WHERE wc IS NOT NULL"""

AO_SQL = f"""WITH {Q.OF}, {Q.ON}, {Q.ONY},
ry AS (SELECT y.rgn_id AS region_id, year, (1 - (1 - need) * (1 - access)) * 1.0 AS sd
       FROM (SELECT rgn_id, year, ao_need AS need FROM ony) y
       LEFT JOIN (SELECT rgn_id, ao_access AS access FROM onx WHERE rgn_id IS NOT NULL AND ao_access IS NOT NULL) a USING (rgn_id)),
ym AS (SELECT greatest(min(year), 2000 - 10) AS ym FROM ony),
rc AS (SELECT *, rank() OVER (PARTITION BY region_id ORDER BY year DESC) AS rk FROM ry, ym WHERE year >= ym.ym AND sd IS NOT NULL)
SELECT region_id, 'AO' AS goal, 'status' AS dimension, round(sd * 100, 6) AS score FROM ry WHERE year = 2000
UNION ALL
SELECT region_id, 'AO', 'trend', round(CASE WHEN count(DISTINCT year) > 1 THEN regr_slope(sd, year) * 5 END, 6) FROM rc WHERE rk <= 5 GROUP BY 1"""

ICO_SQL = f"""WITH {Q.LP},
st AS (SELECT s_nationkey + 1 AS rgn_id, p_name AS sciname, l_returnflag,
         coalesce(CASE CAST(floor(sum(CAST(round(l_discount * 100) AS INTEGER)) / count(*)) AS INTEGER)
           WHEN 2 THEN 'LC' WHEN 3 THEN 'NT' WHEN 4 THEN 'VU' WHEN 5 THEN 'EN' WHEN 6 THEN 'CR' WHEN 7 THEN 'EX' END, 'DD') AS cat
       FROM lpx GROUP BY 1, 2, 3),
tr AS (SELECT s_nationkey + 1 AS rgn_id, p_name AS sciname,
         CASE WHEN 2 * sum(CAST(round(l_tax * 100) AS INTEGER)) < 7 * count(*) THEN 'decreasing'
              WHEN 2 * sum(CAST(round(l_tax * 100) AS INTEGER)) < 9 * count(*) THEN 'stable' ELSE 'increasing' END AS cat
       FROM lpx GROUP BY 1, 2),
sm AS (SELECT rgn_id, sciname, avg(w) * 100 AS spp_mean FROM st
       LEFT JOIN (VALUES ('LC', 1.0), ('NT', 0.8), ('VU', 0.6), ('EN', 0.4), ('CR', 0.2), ('EX', 0.0)) r(cat, w) USING (cat) GROUP BY 1, 2),
tm AS (SELECT rgn_id, sciname, avg(w) AS spp_mean FROM tr
       LEFT JOIN (VALUES ('decreasing', -0.5), ('stable', 0.0), ('increasing', 0.5)) r(cat, w) USING (cat) GROUP BY 1, 2)
SELECT rgn_id AS region_id, 'ICO' AS goal, 'status' AS dimension, round(avg(spp_mean), 6) AS score FROM sm GROUP BY 1
UNION ALL
SELECT rgn_id, 'ICO', 'trend', round(avg(spp_mean), 6) FROM tm GROUP BY 1"""

LSP_SQL = f"""WITH {Q.OF}, {Q.ON}, {Q.ONY},
ry AS (SELECT rgn_id AS region_id, year, cp, cmpa FROM ony),
g AS (SELECT k.region_id, y.year, coalesce(ry.cp, 0) AS cp, coalesce(ry.cmpa, 0) AS cmpa
      FROM (SELECT DISTINCT region_id FROM ry) k CROSS JOIN (SELECT DISTINCT year FROM ry) y
      LEFT JOIN ry ON ry.region_id = k.region_id AND ry.year = y.year),
c AS (SELECT region_id, year,
        sum(cp) OVER (PARTITION BY region_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp_cumsum,
        sum(cmpa) OVER (PARTITION BY region_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cmpa_cumsum
      FROM g),
p AS (SELECT region_id, year,
        (least(least(cp_cumsum / a_in * 100, 100) / 30, 1) + least(least(cmpa_cumsum / a_off * 100, 100) / 30, 1)) / 2 AS prop
      FROM c FULL JOIN (SELECT rgn_id AS region_id, rgn_area_inland1km AS a_in, rgn_area_offshore3nm AS a_off FROM onx) r USING (region_id)),
pp AS (SELECT * FROM p WHERE prop IS NOT NULL)
SELECT region_id, 'LSP' AS goal, 'status' AS dimension, round(prop * 100, 6) AS score FROM pp WHERE year = 2000
UNION ALL
SELECT region_id, 'LSP', 'trend', round(least(1.0, greatest(0.0, CASE WHEN count(DISTINCT year) > 1 THEN regr_slope(prop, year) * 5 END)), 6)
FROM pp WHERE year BETWEEN 1996 AND 2000 GROUP BY 1"""

MAR_CTES = f"""{Q.LP}, {Q.MAR}, {Q.OF}, {Q.ONY},
rky AS (SELECT t.rgn_id, t.species_code, t.year, t.tonnes, sp.species, s.sust_coeff
        FROM tonx t LEFT JOIN spx sp USING (species_code) LEFT JOIN susx s USING (rgn_id, species_code)),
k AS (SELECT DISTINCT rgn_id, species, species_code, sust_coeff FROM rky),
y AS (SELECT DISTINCT year FROM rky),
g AS (SELECT k.*, y.year, r.tonnes FROM k CROSS JOIN y
      LEFT JOIN rky r ON r.rgn_id = k.rgn_id AND r.species_code = k.species_code AND r.year = y.year),
m AS (SELECT *, avg(tonnes) OVER (PARTITION BY rgn_id, species, species_code, sust_coeff ORDER BY year
                                  ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS sm FROM g),
ry AS (SELECT rgn_id, year, coalesce(sum(sust_coeff * sm), 0) AS sts FROM m GROUP BY 1, 2),
ry2 AS (SELECT ry.rgn_id, ry.year, sts / NULLIF(o.popsum, 0) AS mar_pop FROM ry LEFT JOIN ony o ON o.rgn_id = ry.rgn_id AND o.year = ry.year),
ref AS (SELECT quantile_cont(mar_pop, 0.95) AS r FROM ry2 WHERE year <= 2000),
st AS (SELECT rgn_id, year, CASE WHEN mar_pop / r IS NULL THEN NULL ELSE least(1.0, mar_pop / r) END AS status FROM ry2, ref)"""

MAR_SQL = f"""WITH {MAR_CTES},
tr AS (SELECT rgn_id, CASE WHEN count(DISTINCT year) FILTER (WHERE status IS NOT NULL) > 1 THEN regr_slope(status, year) * 5 END AS sl
       FROM st WHERE year BETWEEN 1996 AND 2000 GROUP BY 1)
SELECT rgn_id AS region_id, 'MAR' AS goal, 'status' AS dimension, round(round_even(status * 100, 2), 6) AS score FROM st WHERE year = 2000
UNION ALL
SELECT rgn_id, 'MAR', 'trend', round(round_even(CASE WHEN sl IS NULL THEN NULL ELSE greatest(-1.0, least(1.0, sl)) END, 2), 6) FROM tr"""

TW_VALUES = "(VALUES ('NATION_3', 0.25), ('NATION_7', 0.5), ('NATION_11', 0.75), ('Nepal', 0.5), ('Republic of South Sudan', 0.25)) t(rgn_name, multiplier)"

TR_CTES = f"""{Q.OF}, {Q.ONY}, {Q.LN},
names AS (SELECT n_nationkey + 1 AS rgn_id, n_name AS rgn_name FROM nation),
d AS (SELECT o.rgn_id, o.year, Ed, Ep, U, L, ln.tr_sustainability AS S_score FROM ony o LEFT JOIN ln ON ln.rgn_id = o.rgn_id
      WHERE o.year <= 2000 AND o.year > 1995),
tw AS (SELECT n.rgn_id, t.multiplier FROM {TW_VALUES} LEFT JOIN names n ON n.rgn_name = t.rgn_name WHERE n.rgn_id IS NOT NULL),
x AS (SELECT d.rgn_id, d.year, (CASE WHEN Ep IS NULL THEN Ed / NULLIF(L - L * U, 0) ELSE Ep END) * ((S_score - 1) / (7 - 1)) AS x0, tw.multiplier
      FROM d LEFT JOIN tw ON tw.rgn_id = d.rgn_id),
m AS (SELECT rgn_id, year, CASE WHEN multiplier IS NOT NULL THEN multiplier * x0 ELSE x0 END AS Xtr FROM x),
q AS (SELECT year, quantile_cont(Xtr, 0.9) AS Xtr_q FROM m GROUP BY 1),
r AS (SELECT m.rgn_id, m.year, CASE WHEN Xtr / NULLIF(Xtr_q, 0) IS NULL THEN NULL ELSE least(1.0, Xtr / NULLIF(Xtr_q, 0)) END AS rq
      FROM m LEFT JOIN q ON q.year = m.year),
unpop AS (SELECT DISTINCT rgn_id FROM ony WHERE popn = 0)"""

TR_SQL = f"""WITH {TR_CTES},
s AS (SELECT rgn_id, 'status' AS dimension, arg_max_null(rq, year) * 100 AS score FROM r GROUP BY 1
      UNION ALL
      SELECT rgn_id, 'trend', CASE WHEN count(DISTINCT year) > 1 THEN greatest(-1.0, least(1.0, regr_slope(rq, year) * 5)) END
      FROM r WHERE rq IS NOT NULL GROUP BY 1)
SELECT rgn_id AS region_id, 'TR' AS goal, dimension,
       CASE WHEN rgn_id IN (SELECT rgn_id FROM unpop) THEN NULL ELSE round(score, 6) END AS score FROM s"""

PIECEWISE = """CASE WHEN {v} IS NULL THEN NULL WHEN {v} < 0.95 THEN {v} WHEN {v} > 1.05 THEN
  CASE WHEN 1 - 0.5 * ({v} - 1.05) > 0.25 THEN 1 - 0.5 * ({v} - 1.05) ELSE 0.25 END ELSE 1.0 END"""

FIS_SQL = f"""WITH {Q.LP},
nat AS (SELECT n_nationkey, n_regionkey + 1 AS fao FROM nation),
x AS (SELECT lpx.*, fao, replace(p_brand, '#', '') AS tname, (1 + brand_no % 6) * 100000 + brand_no AS tkey
      FROM lpx JOIN nat ON s_nationkey = n_nationkey),
c AS (SELECT CAST(fao AS DOUBLE) AS fao_id, CAST(l_suppkey AS DOUBLE) AS saup_id, tname AS TaxonName, CAST(tkey AS DOUBLE) AS TaxonKey,
             year, sum(l_quantity) AS catch, tname || '_' || CAST(fao AS VARCHAR) AS stock_id
      FROM x GROUP BY fao, l_suppkey, tname, tkey, year),
b AS (SELECT CAST(fao AS DOUBLE) AS fao_id, tname AS TaxonName, year, avg(l_discount) * 20 + 0.5 AS bmsy,
             tname || '_' || CAST(fao AS VARCHAR) AS stock_id
      FROM x WHERE l_returnflag = 'R' GROUP BY fao, tname, year),
a AS (SELECT c.TaxonName, c.TaxonKey, c.year, c.fao_id, c.saup_id, c.catch, c.stock_id, {PIECEWISE.format(v="b.bmsy * 1.0")} AS score
      FROM b JOIN c ON b.stock_id = c.stock_id AND b.year = c.year AND b.TaxonName = c.TaxonName AND b.fao_id = c.fao_id
      WHERE c.TaxonKey >= 600000),
u AS (SELECT * FROM c WHERE NOT (year IN (SELECT year FROM a) AND stock_id IN (SELECT stock_id FROM a))),
bs AS (SELECT fao_id, year, quantile_cont(bmsy, 0.5) AS med FROM b GROUP BY 1, 2),
u2 AS (SELECT u.*, bs.med, pen.penalty FROM u LEFT JOIN bs ON bs.fao_id = u.fao_id AND bs.year = u.year
       LEFT JOIN (VALUES (1.0, 0.01), (2.0, 0.25), (3.0, 0.5), (4.0, 0.8), (5.0, 0.9), (6.0, 1.0)) pen(code, penalty)
         ON pen.code = CAST(substring(CAST(CAST(u.TaxonKey AS BIGINT) AS VARCHAR), 1, 1) AS DOUBLE)
       WHERE pen.penalty IS NOT NULL),
al AS (SELECT TaxonName, TaxonKey, year, fao_id, saup_id, catch, score FROM a
       UNION ALL
       SELECT TaxonName, TaxonKey, year, fao_id, saup_id, catch, {PIECEWISE.format(v="(med * penalty)")} FROM u2),
w AS (SELECT *, catch / NULLIF(sum(catch) OVER (PARTITION BY year, saup_id), 0) AS wprop FROM al),
g AS (SELECT saup_id, year, CASE WHEN count(*) = count(power(score, wprop)) THEN product(power(score, wprop)) END AS status_saup
      FROM w GROUP BY 1, 2),
pa AS (SELECT CAST(s_suppkey AS DOUBLE) AS saup_id, s_nationkey + 1 AS rgn_id,
              (s_acctbal + 1000) / sum(s_acctbal + 1000) OVER (PARTITION BY s_nationkey) AS prop_area FROM supplier),
sd AS (SELECT rgn_id, year, CASE WHEN count(*) = count(status_saup * prop_area) THEN sum(status_saup * prop_area) END AS Status
       FROM g JOIN pa ON g.saup_id = pa.saup_id GROUP BY 1, 2)
SELECT rgn_id AS region_id, 'FIS' AS goal, 'status' AS dimension, round_even(Status * 100, 0) AS score FROM sd WHERE year = 2000
UNION ALL
SELECT rgn_id, 'FIS', 'trend', round_even(CASE WHEN count(DISTINCT year) FILTER (WHERE Status IS NOT NULL) > 1
                                              THEN regr_slope(Status, year) * 5 END, 2) FROM sd GROUP BY 1"""

for _g, _sql in (("CW", CW_SQL), ("SPP", SPP_SQL), ("HAB", HAB_SQL), ("CS", CS_SQL), ("CP", CP_SQL), ("AO", AO_SQL),
                 ("ICO", ICO_SQL), ("LSP", LSP_SQL), ("MAR", MAR_SQL), ("TR", TR_SQL), ("FIS", FIS_SQL)):
    register(f"goal_{_g.lower()}", _sql)(leaf_query(_g))

register("goal_np")(leaf_query("NP", needs=("FIS",)))
register("goal_liv")(leaf_query("LIV"))
register("goal_eco")(leaf_query("ECO"))


@register("hab_contribution", HAB_CONTRIB_SQL)
def q_hab_contribution(spark, sf):
    res = G.cs(store_for(spark, sf, ["CS"]))
    return res.diagnostics["cs_hab_contributions"]


# ---------------------------------------------------------------- composites


def _composite_sql(parts: dict[str, str], body: str) -> str:
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in parts.items())
    return f"WITH {ctes},\n{body}"


FP_SQL = _composite_sql(
    {"s_fis": FIS_SQL, "s_mar": MAR_SQL, "lnw": f"WITH {Q.LN} SELECT rgn_id AS region_id, fp_wildcaught_weight AS w_fis FROM ln"},
    """s AS (SELECT x.*, w.w_fis, CASE WHEN x.goal = 'FIS' THEN w.w_fis ELSE 1 - w.w_fis END AS weight
      FROM (SELECT * FROM s_fis UNION ALL SELECT * FROM s_mar) x LEFT JOIN lnw w ON w.region_id = x.region_id
      WHERE x.dimension NOT IN ('pressures', 'resilience'))
SELECT region_id, 'FP' AS goal, dimension,
  round(CASE WHEN count(*) FILTER (WHERE score IS NOT NULL AND weight IS NULL) > 0 THEN NULL
        ELSE coalesce(sum(score * weight) FILTER (WHERE score IS NOT NULL AND weight <> 0), 0)
             / NULLIF(sum(weight) FILTER (WHERE score IS NOT NULL), 0) END, 6) AS score
FROM s GROUP BY region_id, dimension""",
)

SP_SQL = _composite_sql(
    {"s_ico": ICO_SQL, "s_lsp": LSP_SQL},
    """w AS (SELECT coalesce(i.region_id, l.region_id) AS region_id, coalesce(i.dimension, l.dimension) AS dimension, i.score AS ico, l.score AS lsp
      FROM s_ico i FULL JOIN s_lsp l ON i.region_id = l.region_id AND i.dimension = l.dimension)
SELECT region_id, 'SP' AS goal, dimension,
  round((coalesce(ico, 0) + coalesce(lsp, 0)) / NULLIF((CASE WHEN ico IS NULL THEN 0 ELSE 1 END) + (CASE WHEN lsp IS NULL THEN 0 ELSE 1 END), 0), 6) AS score
FROM w""",
)

BD_SQL = _composite_sql(
    {"s_hab": HAB_SQL, "s_spp": SPP_SQL},
    """x AS (SELECT * FROM s_hab UNION ALL SELECT * FROM s_spp)
SELECT region_id, 'BD' AS goal, dimension, round(avg(score), 6) AS score FROM x WHERE dimension NOT IN ('pressures', 'resilience')
GROUP BY region_id, dimension""",
)


def composite_query(goal: str, leaves: list[str]):
    def run(spark, sf):
        store = store_for(spark, sf, leaves)
        res = run_leaf_goals(store, M.PROXY_PARAMS, only=set(leaves))
        s = rounded(res.scores)  # composites read the published (6 dp) leaf scores
        if goal == "FP":
            s = C.fp(proxy_store(Tables(spark, sf), ["fp_wildcaught_weight"]), s)[0]
        elif goal == "SP":
            s = C.sp(s)
        elif goal == "BD":
            s = C.bd(s)
        elif goal == "LE":
            s = C.le(proxy_store(Tables(spark, sf), ["rgn_georegions", "le_popn"]), s)
        return rounded(s.where(F.col("goal") == goal))

    return run


register("goal_fp", FP_SQL)(composite_query("FP", ["FIS", "MAR"]))
register("goal_sp", SP_SQL)(composite_query("SP", ["ICO", "LSP"]))
register("goal_bd", BD_SQL)(composite_query("BD", ["HAB", "SPP"]))
register("goal_le")(composite_query("LE", ["LIV", "ECO"]))


def _scenario(spark, sf):
    store = proxy_store(Tables(spark, sf)).materialize()
    return store, run_scenario(store, M.PROXY_PARAMS, leaf_digits=6)


@register("finalize")
def q_finalize(spark, sf):
    return _scenario(spark, sf)[1].scores


@register("pre_global")
def q_pre_global(spark, sf):
    store = proxy_store(Tables(spark, sf), GOAL_LAYERS["CW"] + GOAL_LAYERS["SPP"] + ["rgn_global"])
    s = run_leaf_goals(store, M.PROXY_PARAMS, only={"CW", "SPP"}).scores
    # one region is relabelled so the NA rule has a target on the proxy data
    return rounded(C.pre_global(store, s, nullify_label="NATION_0"))


REFERENCE_GOALS = {"FIS", "MAR", "AO", "NP", "CS", "CP", "TR", "ICO", "LSP", "CW", "HAB", "SPP"}


@register("reference_points")
def q_reference_points(spark, sf):
    # of the twelve goals with a reference point, MAR and TR compute a value; the others' rows need no layer
    return run_leaf_goals(store_for(spark, sf, ["MAR", "TR"]), M.PROXY_PARAMS, only=REFERENCE_GOALS).reference_points
