"""SQL oracles of the long goal models (NP, LIV/ECO, LE), the pre-global restriction, the reference-point table and
the finalised scenario. Each restates the model in plain SQL over the driver tables."""

from __future__ import annotations

from . import goal_queries as GQ
from . import proxy_sql as Q
from .registry import ORACLES

NP_SQL = f"""WITH {Q.LP}, {Q.HAB}, {Q.LN}, s_fis AS ({GQ.FIS_SQL}),
nh AS (SELECT s_nationkey + 1 AS rgn_id, {Q.PRODUCT_CASE} AS product, year, sum(l_quantity) AS tonnes
       FROM lpx WHERE l_returnflag = 'A' GROUP BY 1, 2, 3),
nh2 AS (SELECT *, least(1.0, tonnes / NULLIF(0.65 * max(tonnes) OVER (PARTITION BY rgn_id, product), 0)) AS tonnes_rel FROM nh),
pw AS (SELECT rgn_id, product, rev / sum(rev) OVER (PARTITION BY rgn_id) AS prod_weight FROM habx),
rg AS (SELECT n_nationkey + 1 AS rgn_id, n_name AS rgn_name FROM nation),
h AS (SELECT nh2.rgn_id, nh2.product, nh2.year, nh2.tonnes, nh2.tonnes_rel, pw.prod_weight, rg.rgn_name
      FROM nh2 LEFT JOIN pw ON pw.rgn_id = nh2.rgn_id AND pw.product = nh2.product LEFT JOIN rg ON rg.rgn_id = nh2.rgn_id),
coral AS (SELECT rgn_id, km2 FROM extx WHERE habitat = 'coral' AND km2 > 0),
rocky AS (SELECT rgn_id, km2 FROM extx WHERE habitat = 'rocky_reef' AND km2 > 0),
single AS (SELECT h.*, c.km2 FROM h LEFT JOIN coral c ON c.rgn_id = h.rgn_id WHERE h.product = 'corals'
           UNION ALL SELECT h.*, r.km2 FROM h LEFT JOIN rocky r ON r.rgn_id = h.rgn_id WHERE h.product = 'seaweeds'),
dual AS (SELECT * FROM (SELECT h.*, coalesce(r.km2, 0) + coalesce(c.km2, 0) AS km2 FROM h
                        LEFT JOIN coral c ON c.rgn_id = h.rgn_id LEFT JOIN rocky r ON r.rgn_id = h.rgn_id
                        WHERE h.product IN ('shells', 'ornamentals', 'sponges')) WHERE km2 > 0),
e0 AS (SELECT *, CASE WHEN tonnes > 0 AND km2 > 0 THEN tonnes / km2 WHEN NOT (tonnes > 0 AND km2 > 0) THEN 0.0 END AS expos_raw
       FROM (SELECT * FROM single UNION ALL SELECT * FROM dual)),
e1 AS (SELECT *, 0.65 * max(expos_raw) OVER (PARTITION BY product) AS pm FROM e0),
e2 AS (SELECT rgn_id, product, year, tonnes, tonnes_rel, prod_weight, rgn_name,
              CASE WHEN ln(expos_raw + 1) / NULLIF(ln(pm + 1), 0) IS NULL THEN NULL
                   ELSE least(1.0, ln(expos_raw + 1) / NULLIF(ln(pm + 1), 0)) END AS exposure FROM e1),
e3 AS (SELECT rgn_id, product, year, tonnes, tonnes_rel, prod_weight, rgn_name,
              coalesce(exposure, avg(exposure) OVER (PARTITION BY product)) AS exposure FROM e2),
fo AS (SELECT h.*, f.score / 100 AS exposure FROM h
       LEFT JOIN (SELECT region_id, score FROM s_fis WHERE dimension = 'status') f ON f.region_id = h.rgn_id WHERE h.product = 'fish_oil'),
ex AS (SELECT * FROM e3 UNION ALL SELECT * FROM fo),
orn AS (SELECT DISTINCT rgn_id FROM ln WHERE (np_cyanide IS NOT NULL AND np_cyanide > 0) OR (np_blast IS NOT NULL AND np_blast > 0)),
base AS (SELECT DISTINCT rgn_id FROM h),
risk AS (SELECT base.rgn_id, p.product,
                CASE p.product WHEN 'corals' THEN 1.0 WHEN 'sponges' THEN 0.0 WHEN 'shells' THEN 0.0
                     ELSE CASE WHEN orn.rgn_id IS NOT NULL THEN 1.0 ELSE 0.0 END END AS risk
         FROM base CROSS JOIN (VALUES ('corals'), ('sponges'), ('shells'), ('ornamentals')) p(product)
         LEFT JOIN orn ON orn.rgn_id = base.rgn_id),
su AS (SELECT ex.*, risk.risk,
              1 - (coalesce(ex.exposure, 0) + coalesce(risk.risk, 0))
                  / NULLIF(CAST(ex.exposure IS NOT NULL AS INTEGER) + CAST(risk.risk IS NOT NULL AS INTEGER), 0) AS sustainability
       FROM ex LEFT JOIN risk ON risk.rgn_id = ex.rgn_id AND risk.product = ex.product),
su2 AS (SELECT *, tonnes_rel * sustainability AS product_status FROM su WHERE rgn_name <> 'DISPUTED'),
sa AS (SELECT rgn_id, year, coalesce(sum(product_status * prod_weight) FILTER (WHERE prod_weight <> 0), 0) / NULLIF(sum(prod_weight), 0) AS status
       FROM su2 WHERE product_status IS NOT NULL AND prod_weight IS NOT NULL GROUP BY 1, 2),
sa2 AS (SELECT * FROM sa WHERE status IS NOT NULL)
SELECT rgn_id AS region_id, 'NP' AS goal, 'status' AS dimension, round(round_even(status, 4) * 100, 6) AS score FROM sa2 WHERE year = 2000
UNION ALL
SELECT rgn_id, 'NP', 'trend', round(CASE WHEN count(DISTINCT year) > 1 THEN greatest(-1.0, least(1.0, regr_slope(status, year) * 5)) END, 6)
FROM sa2 WHERE year <= 2000 AND year > 1995 GROUP BY 1"""


def _wmean_strict(x: str, w: str) -> str:
    return (f"CASE WHEN count(*) FILTER (WHERE {w} IS NULL) > 0 OR count(*) FILTER (WHERE {x} IS NULL AND coalesce({w}, 1) <> 0) > 0 "
            f"THEN NULL ELSE coalesce(sum({x} * {w}) FILTER (WHERE {w} <> 0), 0) / NULLIF(sum({w}), 0) END")


def _to_regions(src: str) -> str:
    return f"""SELECT component, rgn_id, rgn_name, {_wmean_strict('score', 'w')} AS score_w_avg,
       CASE WHEN count(score) = count(*) THEN avg(score) END AS score_avg, coalesce(sum(w), 0) AS w_sum
FROM {src} LEFT JOIN lookup USING (cntry_key) LEFT JOIN weights USING (cntry_key, component) GROUP BY 1, 2, 3"""


def _gapfill(src: str, component: str) -> str:
    return f"""(SELECT g.rgn_id, coalesce(d.v, m2.m, m1.m) AS score FROM geo g
  LEFT JOIN (SELECT rgn_id, coalesce(score_w_avg, score_avg) AS v, w_sum AS w FROM {src} WHERE component = '{component}' AND rgn_id IS NOT NULL) d
    ON d.rgn_id = g.rgn_id
  LEFT JOIN (SELECT r2, coalesce({_wm_rm()}, avg(v)) AS m FROM gb_{src}_{component} WHERE v IS NOT NULL GROUP BY 1) m2 ON m2.r2 = g.r2
  LEFT JOIN (SELECT r1, coalesce({_wm_rm()}, avg(v)) AS m FROM gb_{src}_{component} WHERE v IS NOT NULL GROUP BY 1) m1 ON m1.r1 = g.r1)"""


def _wm_rm() -> str:
    return ("CASE WHEN count(*) FILTER (WHERE w IS NULL) > 0 THEN NULL "
            "ELSE coalesce(sum(v * w) FILTER (WHERE w <> 0), 0) / NULLIF(sum(w), 0) END")


def _gb(src: str, component: str) -> str:
    return f"""gb_{src}_{component} AS (SELECT g.*, d.v, d.w FROM geo g LEFT JOIN
  (SELECT rgn_id, coalesce(score_w_avg, score_avg) AS v, w_sum AS w FROM {src} WHERE component = '{component}' AND rgn_id IS NOT NULL) d
  ON d.rgn_id = g.rgn_id)"""


LIVECO_CTES = f"""{Q.OF},
sec AS (SELECT n_name AS cntry_key, c_mktsegment AS sector,
  CAST(count(*) FILTER (WHERE year = 2000) AS DOUBLE) AS jcb, CAST(count(*) FILTER (WHERE year = 1996) AS DOUBLE) AS jrb,
  CAST(count(*) FILTER (WHERE year = 2000 AND o_orderpriority = '1-URGENT') AS DOUBLE) AS jca,
  CAST(count(*) FILTER (WHERE year = 1996 AND o_orderpriority = '1-URGENT') AS DOUBLE) AS jra,
  coalesce(sum(o_totalprice) FILTER (WHERE year = 2000), 0) AS rcb, coalesce(sum(o_totalprice) FILTER (WHERE year = 1996), 0) AS rrb,
  coalesce(sum(o_totalprice) FILTER (WHERE year = 2000 AND o_orderpriority = '1-URGENT'), 0) AS rca,
  coalesce(sum(o_totalprice) FILTER (WHERE year = 1996 AND o_orderpriority = '1-URGENT'), 0) AS rra,
  avg(o_totalprice) FILTER (WHERE year = 2000) AS wcb, avg(o_totalprice) FILTER (WHERE year = 1996) AS wrb,
  avg(o_totalprice) FILTER (WHERE year = 2000 AND o_orderpriority = '1-URGENT') AS wca,
  avg(o_totalprice) FILTER (WHERE year = 1996 AND o_orderpriority = '1-URGENT') AS wra
  FROM ofx GROUP BY 1, 2),
model AS (SELECT 'jobs' AS metric, cntry_key, sector, jcb AS cb, jrb AS rb, jca AS ca, jra AS ra FROM sec
          UNION ALL SELECT 'rev', cntry_key, sector, rcb, rrb, rca, rra FROM sec
          UNION ALL SELECT 'wage', cntry_key, sector, wcb, wrb, wca, wra FROM sec),
jr AS (SELECT metric, cntry_key, (coalesce(sum(cb), 0) / NULLIF(coalesce(sum(rb), 0), 0)) / NULLIF(avg(ca) / NULLIF(avg(ra), 0), 0) AS score
       FROM model WHERE rb <> 0 AND ra <> 0 AND metric IN ('jobs', 'rev') GROUP BY 1, 2),
t0 AS (SELECT metric, cntry_key, avg((cb / NULLIF(rb, 0)) / NULLIF(ca / NULLIF(ra, 0), 0)) AS w_prime
       FROM model WHERE metric = 'wage' AND rb <> 0 AND ra <> 0 GROUP BY 1, 2),
ppp AS (SELECT n_name AS cntry_key, year, avg(o_totalprice) / 1000 AS usd FROM ofx GROUP BY 1, 2),
p AS (SELECT cntry_key, arg_max_null(usd, year) AS ppp_last FROM ppp GROUP BY 1),
t2 AS (SELECT t0.metric, t0.cntry_key, t0.w_prime * p.ppp_last AS score FROM t0 JOIN p ON p.cntry_key = t0.cntry_key WHERE p.ppp_last IS NOT NULL),
wage AS (SELECT metric, cntry_key, score / NULLIF((SELECT max(score) FROM t2), 0) AS score FROM t2),
comb AS (SELECT * FROM jr UNION ALL SELECT * FROM wage),
wide AS (SELECT cntry_key, max(score) FILTER (WHERE metric = 'jobs') AS jobs, max(score) FILTER (WHERE metric = 'wage') AS wage FROM comb GROUP BY 1),
stv AS (SELECT cntry_key, 'livelihood' AS component,
               (coalesce(jobs, 0) + coalesce(wage, 0)) / NULLIF(CAST(jobs IS NOT NULL AS INTEGER) + CAST(wage IS NOT NULL AS INTEGER), 0) AS value FROM wide
        UNION ALL SELECT cntry_key, 'economy', score FROM comb WHERE metric = 'rev'),
ss AS (SELECT cntry_key, component, least(value, 1.0) AS score FROM stv WHERE value IS NOT NULL),
lookup AS (SELECT n_nationkey + 1 AS rgn_id, n_name AS rgn_name, n_name AS cntry_key FROM nation),
weights AS (SELECT n_name AS cntry_key, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS w, 'livelihood' AS component FROM ofx WHERE year = 2000 GROUP BY 1
            UNION ALL
            SELECT cntry_key, arg_max_null(usd, year), 'economy' FROM
              (SELECT n_name AS cntry_key, year, sum(o_totalprice) AS usd FROM ofx WHERE year >= 1997 GROUP BY 1, 2) GROUP BY 1),
sr AS ({_to_regions('ss')}),
adj AS (SELECT 'jobs' AS metric, n_name AS cntry_key, year, 100 - avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) * 100 AS value
        FROM ofx GROUP BY 2, 3
        UNION ALL SELECT 'rev', n_name, year, sum(o_totalprice) FROM ofx GROUP BY 2, 3),
mcsy0 AS (SELECT 'jobs' AS metric, n_name AS cntry_key, c_mktsegment AS sector, year, CAST(count(*) AS DOUBLE) AS base_value FROM ofx GROUP BY 2, 3, 4
          UNION ALL SELECT 'rev', n_name, c_mktsegment, year, sum(o_totalprice) FROM ofx GROUP BY 2, 3, 4
          UNION ALL SELECT 'wage', n_name, c_mktsegment, year, avg(o_totalprice) FROM ofx GROUP BY 2, 3, 4),
mv AS (SELECT m.*, m.base_value / NULLIF(CASE WHEN m.metric = 'wage' THEN 1.0 ELSE a.value END, 0) AS value
       FROM mcsy0 m LEFT JOIN adj a ON a.metric = m.metric AND a.cntry_key = m.cntry_key AND a.year = m.year),
mcs AS (SELECT metric, cntry_key, sector,
               CASE WHEN count(DISTINCT year) > 1 THEN greatest(-1.0, least(1.0, regr_slope(value, year) * 5)) END AS trend, sum(value) AS value_sum
        FROM mv WHERE value IS NOT NULL GROUP BY 1, 2, 3),
mc AS (SELECT metric, cntry_key, CASE WHEN count(trend) = count(*) THEN avg(trend) END AS trend FROM mcs WHERE metric = 'wage' GROUP BY 1, 2
       UNION ALL
       SELECT metric, cntry_key, {_wmean_strict('trend', 'value_sum')} FROM mcs WHERE metric IN ('jobs', 'rev') GROUP BY 1, 2),
gc AS (SELECT cntry_key, avg(trend) AS score, 'livelihood' AS component FROM mc WHERE metric IN ('jobs', 'wage') AND trend IS NOT NULL GROUP BY 1
       UNION ALL SELECT cntry_key, trend, 'economy' FROM mc WHERE metric = 'rev'),
gr AS (SELECT * FROM ({_to_regions('gc')}) WHERE rgn_id IS NOT NULL),
geo AS (SELECT n_nationkey + 1 AS rgn_id, 1 AS r0, CASE WHEN n_regionkey <= 1 THEN 10 ELSE 20 END AS r1, n_regionkey + 100 AS r2 FROM nation),
{_gb('sr', 'livelihood')}, {_gb('sr', 'economy')}, {_gb('gr', 'livelihood')}, {_gb('gr', 'economy')},
liveco AS (
  SELECT rgn_id AS region_id, 'LIV' AS goal, 'status' AS dimension, score * 100 AS score FROM {_gapfill('sr', 'livelihood')}
  UNION ALL SELECT rgn_id, 'LIV', 'trend', score FROM {_gapfill('gr', 'livelihood')}
  UNION ALL SELECT rgn_id, 'ECO', 'status', score * 100 FROM {_gapfill('sr', 'economy')}
  UNION ALL SELECT rgn_id, 'ECO', 'trend', score FROM {_gapfill('gr', 'economy')})"""

LIV_SQL = f"WITH {LIVECO_CTES} SELECT region_id, goal, dimension, round(score, 6) AS score FROM liveco WHERE goal = 'LIV'"
ECO_SQL = f"WITH {LIVECO_CTES} SELECT region_id, goal, dimension, round(score, 6) AS score FROM liveco WHERE goal = 'ECO'"

LE_SQL = f"""WITH {LIVECO_CTES}, {Q.ONY},
r6 AS (SELECT region_id, goal, dimension, round(score, 6) AS score FROM liveco),
w AS (SELECT region_id, dimension, max(score) FILTER (WHERE goal = 'ECO') AS eco, max(score) FILTER (WHERE goal = 'LIV') AS liv
      FROM r6 GROUP BY 1, 2),
unpop AS (SELECT rgn_id FROM ony GROUP BY 1 HAVING coalesce(arg_max_null(popn, year), 0) = 0)
SELECT region_id, 'LE' AS goal, dimension,
       CASE WHEN region_id IN (SELECT rgn_id FROM unpop) THEN NULL
            ELSE round((coalesce(eco, 0) + coalesce(liv, 0)) / NULLIF(CAST(eco IS NOT NULL AS INTEGER) + CAST(liv IS NOT NULL AS INTEGER), 0), 6) END AS score
FROM w"""

PRE_GLOBAL_SQL = f"""WITH s_cw AS ({GQ.CW_SQL}), s_spp AS ({GQ.SPP_SQL}),
x AS (SELECT * FROM s_cw UNION ALL SELECT * FROM s_spp),
rg AS (SELECT n_nationkey + 1 AS region_id, n_name AS label FROM nation UNION ALL SELECT 0, NULL)
SELECT x.region_id, x.goal, x.dimension, CASE WHEN rg.label = 'NATION_0' THEN NULL ELSE x.score END AS score
FROM x JOIN rg ON rg.region_id = x.region_id"""

REFPOINTS_SQL = f"""WITH
mar AS (WITH {GQ.MAR_CTES}
        SELECT 'MAR' AS goal, 'spatial 95th quantile' AS method,
               'region id: ' || CAST(arg_min(rgn_id, (mar_pop, rgn_id, year)) AS VARCHAR) || ' value: ' || CAST(round(min(r), 6) AS VARCHAR) AS reference_point
        FROM ry2, ref WHERE year <= 2000 AND mar_pop >= r),
tr AS (WITH {GQ.TR_CTES}
       SELECT 'TR' AS goal, 'spatial: 90th quantile' AS method, CAST(round(Xtr_q, 6) AS VARCHAR) AS reference_point FROM q WHERE year = 2000)
SELECT * FROM mar UNION ALL SELECT * FROM tr
UNION ALL SELECT * FROM (VALUES
  ('FIS', 'b/bmsy: modeled', CAST(NULL AS VARCHAR)),
  ('NP', 'Harvest peak within region times 0.65 buffer', 'varies for each region'),
  ('CS', 'Health/condition variable based on current vs. historic extent', 'varies for each region/habitat'),
  ('CP', 'Health/condition variable based on current vs. historic extent', 'varies for each region/habitat'),
  ('LSP', '30% marine protected area; 30% coastal protected area', 'varies by area of region''s eez and 1 km inland'),
  ('AO', '??', NULL),
  ('ICO', 'scaled IUCN risk categories', NULL),
  ('CW', 'spatial: pressures scaled from 0-1 at raster level', NULL),
  ('HAB', 'Health/condition variable based on current vs. historic extent', 'varies for each region/habitat'),
  ('SPP', 'Average of IUCN risk categories, scaled to historic extinction', NULL)) v(goal, method, reference_point)"""

ORACLES.update({
    "goal_np": NP_SQL.strip(),
    "goal_liv": LIV_SQL.strip(),
    "goal_eco": ECO_SQL.strip(),
    "goal_le": LE_SQL.strip(),
    "pre_global": PRE_GLOBAL_SQL.strip(),
    "reference_points": REFPOINTS_SQL.strip(),
})


def _rowmean(a: str, b: str) -> str:
    return f"(coalesce({a}, 0) + coalesce({b}, 0)) / NULLIF(CAST({a} IS NOT NULL AS INTEGER) + CAST({b} IS NOT NULL AS INTEGER), 0)"


def _finalize_parts() -> dict[str, str]:
    from . import metadata as M

    leaves = {
        "fis": GQ.FIS_SQL, "mar": GQ.MAR_SQL, "ao": GQ.AO_SQL, "np": NP_SQL, "cs": GQ.CS_SQL, "cp": GQ.CP_SQL, "tr": GQ.TR_SQL,
        "liv": LIV_SQL, "eco": ECO_SQL, "ico": GQ.ICO_SQL, "lsp": GQ.LSP_SQL, "cw": GQ.CW_SQL, "hab": GQ.HAB_SQL, "spp": GQ.SPP_SQL,
    }
    goals = ", ".join(f"('{g[3]}')" for g in M.GOALS) + ", ('Index')"
    dims = ", ".join(f"('{d}')" for d in M.DIMENSIONS)
    not_pr = "dimension NOT IN ('pressures', 'resilience')"
    composites = f"""lnw AS (WITH {Q.LN} SELECT rgn_id AS region_id, fp_wildcaught_weight AS w_fis FROM ln),
fp_in AS (SELECT x.*, CASE WHEN x.goal = 'FIS' THEN w.w_fis ELSE 1 - w.w_fis END AS weight
          FROM leaf x LEFT JOIN lnw w ON w.region_id = x.region_id WHERE x.goal IN ('FIS', 'MAR') AND x.{not_pr}),
fp AS (SELECT region_id, 'FP' AS goal, dimension,
              CASE WHEN count(*) FILTER (WHERE score IS NOT NULL AND weight IS NULL) > 0 THEN NULL
                   ELSE coalesce(sum(score * weight) FILTER (WHERE score IS NOT NULL AND weight <> 0), 0)
                        / NULLIF(sum(weight) FILTER (WHERE score IS NOT NULL), 0) END AS score
       FROM fp_in GROUP BY region_id, dimension),
s1 AS (SELECT * FROM leaf UNION ALL SELECT * FROM fp),
lew AS (SELECT region_id, dimension, max(score) FILTER (WHERE goal = 'ECO') AS eco, max(score) FILTER (WHERE goal = 'LIV') AS liv
        FROM s1 WHERE goal IN ('LIV', 'ECO') AND dimension IN ('status', 'trend', 'score', 'future') GROUP BY 1, 2),
s2 AS (SELECT * FROM s1 UNION ALL SELECT region_id, 'LE', dimension, {_rowmean('eco', 'liv')} FROM lew),
unpop AS (WITH {Q.OF}, {Q.ONY} SELECT rgn_id FROM ony GROUP BY 1 HAVING coalesce(arg_max_null(popn, year), 0) = 0),
s3 AS (SELECT region_id, goal, dimension,
              CASE WHEN goal IN ('LIV', 'ECO', 'LE') AND {not_pr} AND region_id IN (SELECT rgn_id FROM unpop) THEN NULL ELSE score END AS score
       FROM s2),
spw AS (SELECT region_id, dimension, max(score) FILTER (WHERE goal = 'ICO') AS ico, max(score) FILTER (WHERE goal = 'LSP') AS lsp
        FROM s3 WHERE goal IN ('ICO', 'LSP') AND {not_pr} GROUP BY 1, 2),
s4 AS (SELECT * FROM s3 UNION ALL SELECT region_id, 'SP', dimension, {_rowmean('ico', 'lsp')} FROM spw),
s5 AS (SELECT * FROM s4 UNION ALL
       SELECT region_id, 'BD', dimension, avg(score) FROM s4 WHERE goal IN ('HAB', 'SPP') AND {not_pr} GROUP BY region_id, dimension)"""
    restrict_and_grid = f"""rg AS (SELECT n_nationkey + 1 AS region_id FROM nation UNION SELECT 0),
s6 AS (SELECT * FROM s5 WHERE region_id IN (SELECT region_id FROM rg)),
grid AS (SELECT rg.region_id, d.dimension, g.goal FROM rg CROSS JOIN (VALUES {dims}) d(dimension) CROSS JOIN (VALUES {goals}) g(goal)
         WHERE NOT (d.dimension IN ('pressures', 'resilience', 'trend') AND rg.region_id = 0)
           AND NOT (d.dimension IN ('pressures', 'resilience', 'status', 'trend') AND g.goal = 'Index'))
SELECT coalesce(s6.goal, grid.goal) AS goal, coalesce(s6.dimension, grid.dimension) AS dimension,
       coalesce(s6.region_id, grid.region_id) AS region_id, round_even(round(s6.score, 9), 2) AS score
FROM s6 FULL JOIN grid ON s6.goal = grid.goal AND s6.dimension = grid.dimension AND s6.region_id = grid.region_id"""
    return {
        "leaf_ctes": ",\n".join(f"s_{k} AS ({v})" for k, v in leaves.items()),
        "leaf_union": " UNION ALL ".join(f"SELECT * FROM s_{k}" for k in leaves),
        "composites": composites,
        "restrict_and_grid": restrict_and_grid,
    }


ORACLES_FINALIZE_PARTS = _finalize_parts()


def _finalize_sql() -> str:
    b = ORACLES_FINALIZE_PARTS
    return f"""WITH {b['leaf_ctes']},
leaf AS ({b['leaf_union']}),
{b['composites']},
{b['restrict_and_grid']}"""


ORACLES["finalize"] = _finalize_sql().strip()
