"""The proxy layer families written as plain SQL CTEs (wide form), for the DuckDB oracles of the goal queries.

Each CTE is an independent statement of the same derivation as ``sources/proxy.py``; the oracles then restate each
goal model in SQL over these CTEs.
"""

from __future__ import annotations

HABITAT_CASE = """CASE p_type WHEN 'STANDARD' THEN 'coral' WHEN 'ECONOMY' THEN 'mangrove' WHEN 'PROMO' THEN 'saltmarsh'
  WHEN 'LARGE' THEN 'seagrass' WHEN 'SMALL' THEN 'soft_bottom' WHEN 'MEDIUM' THEN 'rocky_reef' ELSE p_type END"""
PRODUCT_CASE = """CASE p_type WHEN 'STANDARD' THEN 'corals' WHEN 'ECONOMY' THEN 'ornamentals' WHEN 'PROMO' THEN 'shells'
  WHEN 'LARGE' THEN 'sponges' WHEN 'SMALL' THEN 'seaweeds' WHEN 'MEDIUM' THEN 'fish_oil' ELSE p_type END"""

LN = """ln AS (
  SELECT s_nationkey + 1 AS rgn_id,
    avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) * 10 AS po_pathogens,
    avg(l_tax) * 12.5 AS po_nutrients_3nm,
    avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) * 10 AS po_chemicals_3nm,
    avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) / 50 AS po_trash,
    (avg(CASE WHEN l_returnflag = 'N' THEN l_discount END) - 0.05) * 10 AS cw_pesticide_trend,
    (avg(CASE WHEN l_returnflag = 'A' THEN l_tax END) - 0.04) * 12.5 AS cw_fertilizer_trend,
    (avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) - 25.5) / 25.5 AS cw_coastalpopn_trend,
    (avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) - 0.05) * 10 AS cw_pathogen_trend,
    1 + avg(l_discount) * 60 AS tr_sustainability,
    sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) / NULLIF(sum(l_extendedprice), 0) AS fp_wildcaught_weight,
    avg(CASE WHEN l_discount = 0 AND l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) * 10 AS np_blast,
    avg(CASE WHEN l_discount >= 0.1 AND l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) * 10 AS np_cyanide
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"""

OF = """ofx AS (
  SELECT o.*, c_nationkey, c_mktsegment, n_name, CAST(year(o_orderdate) AS INTEGER) AS year
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

ON = """onx AS (
  SELECT c_nationkey + 1 AS rgn_id,
    avg(o_totalprice) / 500000 AS spp_status,
    avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) - 0.2 AS spp_trend,
    avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS ao_access,
    CAST(count(*) AS DOUBLE) AS rgn_area_inland1km,
    count(*) * 0.5 AS rgn_area_offshore3nm,
    CAST(count(DISTINCT o_custkey) AS DOUBLE) AS rgn_area
  FROM ofx GROUP BY 1)"""

ONY = """ony AS (
  SELECT c_nationkey + 1 AS rgn_id, n_name AS cntry_key, year,
    avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) * 2 AS ao_need,
    CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS Ed,
    CASE WHEN year <= 1996 THEN avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) END AS Ep,
    avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS U,
    CAST(count(*) AS DOUBLE) AS L,
    CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000) AS DOUBLE) AS popn,
    CAST(count(DISTINCT o_custkey) AS DOUBLE) AS popsum,
    CAST(count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS DOUBLE) AS cp,
    CAST(count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') AS DOUBLE) AS cmpa,
    avg(o_totalprice) / 1000 AS ppp,
    CAST(count(DISTINCT o_custkey) AS DOUBLE) AS workforce,
    sum(o_totalprice) AS rev_adj,
    avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) * 100 AS unemployment,
    sum(o_totalprice) AS gdp
  FROM ofx GROUP BY 1, 2, 3)"""

LP = """lpx AS (
  SELECT l.*, s_nationkey, p_type, p_brand, p_name, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) AS brand_no
  FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""

HAB = f"""habg AS (
  SELECT s_nationkey + 1 AS rgn_id, {HABITAT_CASE} AS habitat, {PRODUCT_CASE} AS product, l_linestatus,
    sum(l_quantity) AS q, count(*) AS n,
    sum(CASE WHEN l_returnflag = 'N' THEN l_discount END) AS dn, count(*) FILTER (WHERE l_returnflag = 'N') AS nn,
    sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN l_quantity ELSE 0 END) AS ext,
    sum(l_extendedprice) AS rev
  FROM lpx GROUP BY 1, 2, 3, 4),
habx AS (
  SELECT rgn_id, habitat, product, sum(q) / sum(n) / 26 AS health, (sum(dn) / sum(nn) - 0.05) * 10 AS trend,
         sum(ext) AS km2, sum(rev) AS rev
  FROM habg GROUP BY 1, 2, 3),
extx AS (
  SELECT rgn_id, habitat, km2 FROM habx
  UNION ALL
  SELECT rgn_id, CASE WHEN l_linestatus = 'O' THEN 'mangrove_inland1km' ELSE 'mangrove_offshore' END, ext
  FROM habg WHERE habitat = 'mangrove')"""

MAR = """tonx AS (
  SELECT s_nationkey + 1 AS rgn_id, brand_no AS species_code, year, sum(l_quantity) AS tonnes
  FROM lpx WHERE l_returnflag = 'R' AND l_discount >= 0.08 GROUP BY 1, 2, 3),
susx AS (SELECT s_nationkey + 1 AS rgn_id, brand_no AS species_code, 1 - avg(l_discount) * 5 AS sust_coeff FROM lpx GROUP BY 1, 2),
spx AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) AS species_code, p_brand AS species FROM part)"""
