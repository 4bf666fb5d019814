"""Single-operator queries over the driver tables, each with its DuckDB oracle.

Region = customer or supplier nation, year = order or ship year, category = brand, segment, priority or type; values
are sums and means of prices, quantities and discounts. Every query reads whole tables; NULLs that the driver tables
lack are introduced with ``nullif``/``CASE`` on both sides so the NA rules are exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import quantiles as QT
from ..operators import reshape as R
from ..operators import windows as W
from ..sources.tables import Tables, line_facts, nation_year_revenue, order_facts, year_of
from .registry import register

# ---------------------------------------------------------------- shared SQL fragments

NY_SQL = """ny AS (
  SELECT c_nationkey AS rgn_id, CAST(year(o_orderdate) AS INTEGER) AS year,
         sum(o_totalprice) AS revenue, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

OF_SQL = """of AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, c_nationkey, c_mktsegment,
         CAST(year(o_orderdate) AS INTEGER) AS year
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

LF_SQL = """lf AS (
  SELECT l.*, s_nationkey, CAST(year(l_shipdate) AS INTEGER) AS year
  FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey)"""


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- aggregates (A*)


@register(
    "trend_slope",
    f"""WITH {NY_SQL}
SELECT rgn_id, CASE WHEN count(DISTINCT year) > 1 THEN round(regr_slope(revenue / n_orders / 1000.0, year) * 5, 6) END AS trend
FROM ny GROUP BY rgn_id""",
)
def q_trend_slope(spark, sf):
    ny = nation_year_revenue(Tables(spark, sf))
    return ny.groupBy("rgn_id").agg(r6(S.trend_slope(F.col("revenue") / F.col("n_orders") / 1000.0, "year")).alias("trend"))


@register(
    "clamp",
    f"""WITH {OF_SQL}
SELECT o_custkey AS c_custkey,
       CASE WHEN count(DISTINCT year) > 1 THEN round(greatest(-1.0, least(1.0, regr_slope(o_totalprice / 100000.0, year) * 5)), 9) END AS trend
FROM of GROUP BY o_custkey""",
)
def q_clamp(spark, sf):
    of = order_facts(Tables(spark, sf))
    return of.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(S.clamp(S.trend_slope(F.col("o_totalprice") / 100000.0, "year"), -1.0, 1.0), 9).alias("trend")
    )


@register(
    "geo_mean",
    f"""WITH {LF_SQL}
SELECT s_nationkey AS rgn_id, l_returnflag,
       round(CASE WHEN sum(CASE WHEN 1 - l_discount = 0 THEN 1 ELSE 0 END) > 0 THEN 0.0
                  ELSE exp(avg(CASE WHEN 1 - l_discount > 0 THEN ln(1 - l_discount) END)) END * 100, 6) AS score
FROM lf GROUP BY 1, 2""",
)
def q_geo_mean(spark, sf):
    lf = line_facts(Tables(spark, sf))
    return lf.groupBy(F.col("s_nationkey").alias("rgn_id"), "l_returnflag").agg(
        r6(S.geo_mean(1 - F.col("l_discount")) * 100).alias("score")
    )


_BRAND_SCORE_SQL = f"""{LF_SQL},
b AS (SELECT s_nationkey AS rgn_id, year, p_brand, avg(1 - l_discount) AS score,
             sum(l_extendedprice) AS catch
      FROM lf JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
w AS (SELECT *, catch / sum(catch) OVER (PARTITION BY rgn_id, year) AS wprop FROM b)"""


def _brand_scores(t):
    lf = line_facts(t).join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    b = lf.groupBy(F.col("s_nationkey").alias("rgn_id"), "year", "p_brand").agg(
        F.avg(1 - F.col("l_discount")).alias("score"), F.sum("l_extendedprice").alias("catch")
    )
    return b.withColumn("wprop", W.share_of_total("catch", ["rgn_id", "year"]))


@register(
    "geo_wmean",
    f"""WITH {_BRAND_SCORE_SQL}
SELECT rgn_id, year, round(exp(sum(ln(power(score, wprop)))), 6) AS status
FROM w GROUP BY 1, 2""",
)
def q_geo_wmean(spark, sf):
    w = _brand_scores(Tables(spark, sf))
    return w.groupBy("rgn_id", "year").agg(r6(S.geo_wmean("score", "wprop")).alias("status"))


_WM_SQL = """x AS (
  SELECT l_partkey,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS x,
         CASE WHEN l_quantity = 50 THEN NULL ELSE l_extendedprice END AS w,
         l_discount
  FROM lineitem)"""


def _wm_frame(t):
    return t.lineitem.select(
        "l_partkey",
        F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_discount")).alias("x"),
        F.when(F.col("l_quantity") == 50, None).otherwise(F.col("l_extendedprice")).alias("w"),
        "l_discount",
    )


@register(
    "weighted_mean",
    f"""WITH {_WM_SQL}
SELECT l_partkey,
  round(CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND w IS NULL) > 0 THEN NULL
        ELSE coalesce(sum(x * w) FILTER (WHERE x IS NOT NULL AND w <> 0), 0) / NULLIF(sum(w) FILTER (WHERE x IS NOT NULL), 0) END, 6) AS wmean
FROM x GROUP BY l_partkey""",
)
def q_weighted_mean(spark, sf):
    x = _wm_frame(Tables(spark, sf))
    return x.groupBy("l_partkey").agg(r6(S.weighted_mean("x", "w", na_rm=True)).alias("wmean"))


@register(
    "wmean_fallback",
    f"""WITH {_WM_SQL}
SELECT l_partkey,
  round(coalesce(CASE WHEN count(*) FILTER (WHERE w IS NULL) > 0 THEN NULL
                 ELSE sum(l_discount * w) FILTER (WHERE w <> 0) / NULLIF(sum(w), 0) END, avg(l_discount)), 6) AS score
FROM x GROUP BY l_partkey""",
)
def q_wmean_fallback(spark, sf):
    x = _wm_frame(Tables(spark, sf))
    return x.groupBy("l_partkey").agg(r6(S.wmean_fallback("l_discount", "w")).alias("score"))


@register(
    "weighted_ratio",
    f"""WITH {LF_SQL}
SELECT s_nationkey AS rgn_id,
       round(least(1.0, sum(p_size * (1 - l_discount) * 1.08 * l_quantity) / sum(p_size * l_quantity)) * 100, 6) AS status
FROM lf JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def q_weighted_ratio(spark, sf):
    t = Tables(spark, sf)
    lf = line_facts(t).join(t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    num = F.sum(F.col("p_size") * (1 - F.col("l_discount")) * 1.08 * F.col("l_quantity"))
    den = F.sum(F.col("p_size") * F.col("l_quantity"))
    return lf.groupBy(F.col("s_nationkey").alias("rgn_id")).agg(r6(S.clamp(S.safe_div(num, den), hi=1.0) * 100).alias("status"))


_RR_SQL = f"""{OF_SQL},
m AS (SELECT c_nationkey AS cntry_key, c_mktsegment AS sector,
             sum(CASE WHEN year = 2000 THEN o_totalprice ELSE 0 END) AS cur_base_value,
             sum(CASE WHEN year = 1996 THEN o_totalprice ELSE 0 END) AS ref_base_value,
             CAST(count(*) FILTER (WHERE year = 2000 AND o_orderpriority = '1-URGENT') AS DOUBLE) AS cur_adj_value,
             CAST(count(*) FILTER (WHERE year = 1996 AND o_orderpriority = '1-URGENT') AS DOUBLE) AS ref_adj_value
      FROM of GROUP BY 1, 2)"""


def _rr_frame(t):
    of = order_facts(t)
    y, p = F.col("year"), F.col("o_totalprice")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return of.groupBy(F.col("c_nationkey").alias("cntry_key"), F.col("c_mktsegment").alias("sector")).agg(
        F.sum(F.when(y == 2000, p).otherwise(0.0)).alias("cur_base_value"),
        F.sum(F.when(y == 1996, p).otherwise(0.0)).alias("ref_base_value"),
        F.count(F.when((y == 2000) & urgent, 1)).cast("double").alias("cur_adj_value"),
        F.count(F.when((y == 1996) & urgent, 1)).cast("double").alias("ref_adj_value"),
    )


@register(
    "ratio_of_ratios",
    f"""WITH {_RR_SQL}
SELECT cntry_key, round((sum(cur_base_value) / sum(ref_base_value)) / (avg(cur_adj_value) / avg(ref_adj_value)), 6) AS score,
       count(*) AS n_sector
FROM m WHERE ref_base_value <> 0 AND ref_adj_value <> 0 GROUP BY 1""",
)
def q_ratio_of_ratios(spark, sf):
    m = _rr_frame(Tables(spark, sf)).where((F.col("ref_base_value") != 0) & (F.col("ref_adj_value") != 0))
    score = S.safe_div(
        S.safe_div(F.sum("cur_base_value"), F.sum("ref_base_value")),
        S.safe_div(F.avg("cur_adj_value"), F.avg("ref_adj_value")),
    )
    return m.groupBy("cntry_key").agg(r6(score).alias("score"), F.count(F.lit(1)).alias("n_sector"))


@register(
    "mean_of_ratios",
    f"""WITH {_RR_SQL}
SELECT cntry_key, round(avg((cur_base_value / ref_base_value) / NULLIF(cur_adj_value / ref_adj_value, 0)), 6) AS w_prime,
       count(*) AS n_sector
FROM m WHERE ref_base_value <> 0 AND ref_adj_value <> 0 GROUP BY 1""",
)
def q_mean_of_ratios(spark, sf):
    m = _rr_frame(Tables(spark, sf)).where((F.col("ref_base_value") != 0) & (F.col("ref_adj_value") != 0))
    wp = S.safe_div(S.safe_div("cur_base_value", "ref_base_value"), S.safe_div("cur_adj_value", "ref_adj_value"))
    return m.groupBy("cntry_key").agg(r6(F.avg(wp)).alias("w_prime"), F.count(F.lit(1)).alias("n_sector"))


@register(
    "two_stage_mean",
    """WITH s AS (SELECT p_brand, l_partkey, avg(1 - l_discount) * 100 AS spp_mean
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, round(avg(spp_mean), 6) AS score FROM s GROUP BY 1""",
)
def q_two_stage_mean(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    s1 = li.groupBy("p_brand", "l_partkey").agg((F.avg(1 - F.col("l_discount")) * 100).alias("spp_mean"))
    return s1.groupBy("p_brand").agg(r6(F.avg("spp_mean")).alias("score"))


@register(
    "group_quantile",
    f"""WITH {NY_SQL}
SELECT year, round(quantile_cont(revenue, 0.9), 4) AS revenue_q90, round(median(revenue), 4) AS revenue_median FROM ny GROUP BY 1""",
)
def q_group_quantile(spark, sf):
    ny = nation_year_revenue(Tables(spark, sf))
    return ny.groupBy("year").agg(
        F.round(S.quantile("revenue", 0.9), 4).alias("revenue_q90"), F.round(S.quantile("revenue", 0.5), 4).alias("revenue_median")
    )


@register(
    "raw_group_quantile",
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 4) AS price_q90, round(quantile_cont(l_extendedprice, 0.5), 4) AS price_median,
       round(quantile_cont(l_discount, 0.95), 6) AS discount_q95
FROM lineitem GROUP BY 1, 2""",
)
def q_raw_group_quantile(spark, sf):
    li, keys = Tables(spark, sf).lineitem, ["l_returnflag", "l_linestatus"]
    price = QT.group_quantiles(li, keys, "l_extendedprice", [0.9, 0.5], ["q90", "q50"])
    discount = QT.group_quantiles(li, keys, "l_discount", [0.95], ["q95"])
    both = price.join(discount, keys)
    return both.select(*keys, F.round("q90", 4).alias("price_q90"), F.round("q50", 4).alias("price_median"), r6("q95").alias("discount_q95"))


@register(
    "self_agg_join",
    f"""WITH {NY_SQL}, q AS (SELECT year, quantile_cont(revenue, 0.9) AS q90 FROM ny GROUP BY 1)
SELECT rgn_id, year, round(least(1.0, revenue / q90), 6) AS status FROM ny JOIN q USING (year)""",
)
def q_self_agg_join(spark, sf):
    ny = nation_year_revenue(Tables(spark, sf))
    j = J.self_agg_join(ny, ["year"], S.quantile("revenue", 0.9).alias("q90"), materialize=True)
    return j.select("rgn_id", "year", r6(S.clamp(S.safe_div("revenue", "q90"), hi=1.0)).alias("status"))


_REF_SQL = f"""{NY_SQL}, r AS (SELECT quantile_cont(revenue / n_orders, 0.95) AS ref FROM ny WHERE year <= 2000)"""


@register(
    "global_quantile_ref",
    f"""WITH {_REF_SQL}
SELECT rgn_id, year, round(least(1.0, revenue / n_orders / ref), 6) AS status, round(ref, 4) AS ref FROM ny, r""",
)
def q_global_quantile_ref(spark, sf):
    ny = J.once(nation_year_revenue(Tables(spark, sf)).withColumn("mar_pop", F.col("revenue") / F.col("n_orders")))
    ref = ny.where(F.col("year") <= 2000).agg(S.quantile("mar_pop", 0.95))
    return ny.withColumn("ref", ref.scalar()).select(
        "rgn_id", "year", r6(S.clamp(S.safe_div("mar_pop", "ref"), hi=1.0)).alias("status"), F.round("ref", 4).alias("ref")
    )


@register(
    "ref_holder",
    f"""WITH {_REF_SQL}
SELECT rgn_id, year, round(revenue / n_orders, 4) AS mar_pop, round(ref, 4) AS ref
FROM ny, r WHERE year <= 2000 AND revenue / n_orders >= ref
ORDER BY revenue / n_orders, year, rgn_id LIMIT 1""",
)
def q_ref_holder(spark, sf):
    ny = J.once(nation_year_revenue(Tables(spark, sf)).withColumn("mar_pop", F.col("revenue") / F.col("n_orders")))
    base = ny.where(F.col("year") <= 2000)
    ref = base.agg(S.quantile("mar_pop", 0.95).alias("ref"))
    hit = base.withColumn("ref", ref.scalar()).where(F.col("mar_pop") >= F.col("ref"))
    best = hit.agg(F.min_by(F.struct("rgn_id", "year", "mar_pop", "ref"), F.struct("mar_pop", "year", "rgn_id")).alias("h"))
    return best.where(F.col("h").isNotNull()).select(
        F.col("h.rgn_id").alias("rgn_id"), F.col("h.year").alias("year"),
        F.round("h.mar_pop", 4).alias("mar_pop"), F.round("h.ref", 4).alias("ref"),
    )


@register(
    "max_normalise",
    f"""WITH {NY_SQL}, c AS (SELECT rgn_id, sum(revenue) / sum(n_orders) AS score FROM ny GROUP BY 1)
SELECT rgn_id, round(score / (SELECT max(score) FROM c), 6) AS score FROM c""",
)
def q_max_normalise(spark, sf):
    ny = nation_year_revenue(Tables(spark, sf))
    c = J.once(ny.groupBy("rgn_id").agg((F.sum("revenue") / F.sum("n_orders")).alias("score")))
    return c.select("rgn_id", r6(S.safe_div("score", c.agg(F.max("score")).scalar())).alias("score"))


@register(
    "basic_aggs",
    f"""WITH {LF_SQL}
SELECT s_nationkey AS rgn_id, round(coalesce(sum(l_quantity), 0), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc,
       min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS n_lines,
       round(coalesce(sum(l_quantity) FILTER (WHERE l_quantity > 100), 0), 2) AS sum_big_qty
FROM lf GROUP BY 1""",
)
def q_basic_aggs(spark, sf):
    lf = line_facts(Tables(spark, sf))
    return lf.groupBy(F.col("s_nationkey").alias("rgn_id")).agg(
        F.round(S.sum0("l_quantity"), 2).alias("sum_qty"),
        r6(F.avg(S.nan_to_null("l_discount"))).alias("avg_disc"),
        F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"),
        F.count(F.lit(1)).alias("n_lines"),
        F.round(S.sum0(F.when(F.col("l_quantity") > 100, F.col("l_quantity"))), 2).alias("sum_big_qty"),
    )


@register(
    "latest_value",
    f"""WITH {OF_SQL}, s AS (
  SELECT c_nationkey AS rgn_id, c_mktsegment, year,
         avg(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END) AS price
  FROM of GROUP BY 1, 2, 3)
SELECT rgn_id, c_mktsegment, max(year) AS year, round(arg_max_null(price, year), 4) AS price FROM s GROUP BY 1, 2""",
)
def q_latest_value(spark, sf):
    of = order_facts(Tables(spark, sf))
    s = of.groupBy(F.col("c_nationkey").alias("rgn_id"), "c_mktsegment", "year").agg(
        F.avg(F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice"))).alias("price")
    )
    return s.groupBy("rgn_id", "c_mktsegment").agg(F.max("year").alias("year"), F.round(S.latest("price", "year"), 4).alias("price"))


@register(
    "latest_is_zero",
    f"""WITH {OF_SQL}, s AS (
  SELECT o_custkey, year, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS n_urgent
  FROM of GROUP BY 1, 2)
SELECT o_custkey FROM s GROUP BY 1 HAVING coalesce(arg_max_null(n_urgent, year), 0) = 0""",
)
def q_latest_is_zero(spark, sf):
    of = order_facts(Tables(spark, sf))
    s = of.groupBy("o_custkey", "year").agg(F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).cast("double").alias("n_urgent"))
    last = s.groupBy("o_custkey").agg(S.latest("n_urgent", "year").alias("v"))
    return last.where(F.col("v").isNull() | (F.col("v") == 0)).select("o_custkey")


@register(
    "concat_members",
    """WITH w AS (SELECT n_regionkey, n_name, CASE WHEN sum(s_acctbal) > 10000 THEN sum(s_acctbal) END AS w
           FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_regionkey, coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE w IS NOT NULL), '') AS cntry_w,
       coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE w IS NULL), '') AS cntry_w_na
FROM w GROUP BY 1""",
)
def q_concat_members(spark, sf):
    w = _nation_weights(Tables(spark, sf))
    return w.groupBy("n_regionkey").agg(
        S.concat_members("n_name", F.col("w").isNotNull()).alias("cntry_w"),
        S.concat_members("n_name", F.col("w").isNull()).alias("cntry_w_na"),
    )


def _nation_weights(t):
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    tot = F.sum("s_acctbal")
    return j.groupBy("n_regionkey", "n_name").agg(F.when(tot > 10000, tot).alias("w"))


@register(
    "null_count",
    """WITH w AS (SELECT n_regionkey, n_name, CASE WHEN sum(s_acctbal) > 10000 THEN sum(s_acctbal) END AS w
           FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_regionkey, count(*) AS n, count(*) FILTER (WHERE w IS NULL) AS n_w_na, round(coalesce(sum(w), 0), 2) AS w_sum
FROM w GROUP BY 1""",
)
def q_null_count(spark, sf):
    w = _nation_weights(Tables(spark, sf))
    return w.groupBy("n_regionkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("w").isNull()).alias("n_w_na"), F.round(S.sum0("w"), 2).alias("w_sum")
    )


@register(
    "distinct_rows",
    """SELECT DISTINCT c_nationkey, c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey""",
)
def q_distinct_rows(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    return c.select("c_nationkey", "c_mktsegment").dropDuplicates()


@register(
    "goal_mean",
    f"""WITH {OF_SQL}, s AS (
  SELECT c_nationkey AS region_id, c_mktsegment AS goal, 'status' AS dimension, avg(o_totalprice) / 1000 AS score FROM of GROUP BY 1, 2
  UNION ALL
  SELECT c_nationkey, c_mktsegment, 'trend', CASE WHEN count(DISTINCT year) > 1 THEN regr_slope(o_totalprice / 100000.0, year) * 5 END
  FROM of GROUP BY 1, 2)
SELECT region_id, dimension, round(avg(score), 6) AS score FROM s GROUP BY 1, 2""",
)
def q_goal_mean(spark, sf):
    of = order_facts(Tables(spark, sf))
    g = of.groupBy(F.col("c_nationkey").alias("region_id"), F.col("c_mktsegment").alias("goal"))
    st = g.agg((F.avg("o_totalprice") / 1000).alias("score")).withColumn("dimension", F.lit("status"))
    tr = g.agg(S.trend_slope(F.col("o_totalprice") / 100000.0, "year").alias("score")).withColumn("dimension", F.lit("trend"))
    s = st.unionByName(tr)
    return s.groupBy("region_id", "dimension").agg(r6(F.avg("score")).alias("score"))


# ---------------------------------------------------------------- windows (W*) and grids


# a part is not shipped in every month: the gaps of these series are those of the whole table
_PART_MONTH_SQL = """f AS (
  SELECT l_partkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS ym, sum(l_extendedprice) AS revenue
  FROM lineitem GROUP BY 1, 2)"""


def _part_month(t):
    ym = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("ym")
    return t.lineitem.groupBy("l_partkey", ym).agg(F.sum("l_extendedprice").alias("revenue"))


_GRID_SQL = f"""{_PART_MONTH_SQL},
g AS (SELECT k.l_partkey, y.ym, f.revenue
      FROM (SELECT DISTINCT l_partkey FROM f) k CROSS JOIN (SELECT DISTINCT ym FROM f) y
      LEFT JOIN f ON f.l_partkey = k.l_partkey AND f.ym = y.ym)"""


@register("series_complete", f"WITH {_GRID_SQL} SELECT l_partkey, ym, round(revenue, 2) AS revenue FROM g")
def q_series_complete(spark, sf):
    g = R.complete_series(_part_month(Tables(spark, sf)), ["l_partkey"], "ym", materialize=True)
    return g.select("l_partkey", "ym", F.round("revenue", 2).alias("revenue"))


@register("grid_fill", f"WITH {_GRID_SQL} SELECT l_partkey, ym, round(coalesce(revenue, 0), 2) AS revenue FROM g")
def q_grid_fill(spark, sf):
    g = R.complete_series(_part_month(Tables(spark, sf)), ["l_partkey"], "ym", materialize=True)
    return g.select("l_partkey", "ym", F.round(F.coalesce("revenue", F.lit(0.0)), 2).alias("revenue"))


@register(
    "cumsum",
    f"""WITH {_GRID_SQL}
SELECT l_partkey, ym, round(sum(coalesce(revenue, 0)) OVER (PARTITION BY l_partkey ORDER BY ym
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS revenue_cumsum FROM g""",
)
def q_cumsum(spark, sf):
    g = R.complete_series(_part_month(Tables(spark, sf)), ["l_partkey"], "ym", materialize=True)
    g = g.withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))
    return g.select("l_partkey", "ym", F.round(W.cumsum("revenue", "l_partkey", "ym"), 2).alias("revenue_cumsum"))


_MONTH_SQL = """m AS (
  SELECT c_nationkey AS rgn_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS ym, sum(o_totalprice) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


@register(
    "rolling_mean_centred",
    f"""WITH {_MONTH_SQL}
SELECT rgn_id, ym, round(avg(revenue) OVER (PARTITION BY rgn_id ORDER BY ym ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 6) AS sm_revenue
FROM m""",
)
def q_rolling_mean_centred(spark, sf):
    of = order_facts(Tables(spark, sf))
    m = of.groupBy(
        F.col("c_nationkey").alias("rgn_id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("ym")
    ).agg(F.sum("o_totalprice").alias("revenue"))
    return m.select("rgn_id", "ym", r6(W.rolling_mean_centred("revenue", "rgn_id", "ym", 4)).alias("sm_revenue"))


_BN_SQL = f"""{LF_SQL}, bn AS (
  SELECT s_nationkey AS rgn_id, p_brand, sum(l_extendedprice * (1 - l_discount)) / 10000 AS revenue
  FROM lf JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _brand_nation(t):
    j = line_facts(t).join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("s_nationkey").alias("rgn_id"), "p_brand").agg(
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 10000).alias("revenue")
    )


@register(
    "share_of_total",
    f"WITH {_BN_SQL} SELECT rgn_id, p_brand, round(revenue / sum(revenue) OVER (PARTITION BY rgn_id), 6) AS share FROM bn",
)
def q_share_of_total(spark, sf):
    bn = _brand_nation(Tables(spark, sf))
    return bn.select("rgn_id", "p_brand", r6(W.share_of_total("revenue", "rgn_id")).alias("share"))


@register(
    "peak_reference",
    f"WITH {_BN_SQL} SELECT rgn_id, p_brand, round(0.65 * max(revenue) OVER (PARTITION BY p_brand), 6) AS peak FROM bn",
)
def q_peak_reference(spark, sf):
    bn = _brand_nation(Tables(spark, sf))
    return bn.select("rgn_id", "p_brand", r6(W.peak_reference("revenue", "p_brand", 0.65)).alias("peak"))


@register(
    "log_rescale",
    f"""WITH {_BN_SQL}, p AS (SELECT *, 0.65 * max(revenue) OVER (PARTITION BY p_brand) AS peak FROM bn)
SELECT rgn_id, p_brand, round(least(1.0, ln(revenue + 1) / ln(peak + 1)), 6) AS exposure FROM p""",
)
def q_log_rescale(spark, sf):
    bn = _brand_nation(Tables(spark, sf)).withColumn("peak", W.peak_reference("revenue", "p_brand", 0.65))
    return bn.select("rgn_id", "p_brand", r6(S.log_rescale("revenue", "peak")).alias("exposure"))


# not every nation's suppliers ship every part: the gaps of this grid are those of the whole table
_GAP_SQL = f"""{LF_SQL}, pn AS (
  SELECT s_nationkey AS rgn_id, l_partkey, sum(l_extendedprice * (1 - l_discount)) / 10000 AS revenue FROM lf GROUP BY 1, 2),
g AS (SELECT k.rgn_id, b.l_partkey, pn.revenue
      FROM (SELECT DISTINCT rgn_id FROM pn) k CROSS JOIN (SELECT DISTINCT l_partkey FROM pn) b
      LEFT JOIN pn ON pn.rgn_id = k.rgn_id AND pn.l_partkey = b.l_partkey)"""


def _gap_grid(t):
    pn = line_facts(t).groupBy(F.col("s_nationkey").alias("rgn_id"), "l_partkey").agg(
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 10000).alias("revenue")
    )
    return R.complete_series(pn, ["l_partkey"], "rgn_id", materialize=True)


@register(
    "mean_gapfill",
    f"""WITH {_GAP_SQL}
SELECT rgn_id, l_partkey, round(coalesce(revenue, avg(revenue) OVER (PARTITION BY l_partkey)), 9) AS revenue FROM g""",
)
def q_mean_gapfill(spark, sf):
    g = W.mean_gapfill(_gap_grid(Tables(spark, sf)), "revenue", "l_partkey")
    return g.select("rgn_id", "l_partkey", F.round("revenue", 9).alias("revenue"))


@register(
    "gapfill_flags",
    f"""WITH {_GAP_SQL}
SELECT rgn_id, l_partkey, CASE WHEN revenue IS NULL THEN 'prod_average' ELSE '0' END AS gap_fill FROM g""",
)
def q_gapfill_flags(spark, sf):
    g = W.mean_gapfill(_gap_grid(Tables(spark, sf)), "revenue", "l_partkey", flag="gap_fill", flag_value="prod_average")
    return g.select("rgn_id", "l_partkey", "gap_fill")


@register(
    "top_n_ties",
    f"""WITH {OF_SQL}
SELECT o_custkey, year, o_orderkey FROM (
  SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY year DESC) AS rk FROM of) WHERE rk <= 2""",
)
def q_top_n_ties(spark, sf):
    of = order_facts(Tables(spark, sf))
    return W.keep_top_n_ties(of, "year", "o_custkey", 2).select("o_custkey", "year", "o_orderkey")


# ---------------------------------------------------------------- filters (F*)


@register(
    "year_window",
    f"WITH {NY_SQL} SELECT rgn_id, year, round(revenue, 2) AS revenue FROM ny WHERE year <= 2000 AND year > 2000 - 5",
)
def q_year_window(spark, sf):
    ny = nation_year_revenue(Tables(spark, sf))
    return ny.where(FL.year_window("year", 2000, 5)).select("rgn_id", "year", F.round("revenue", 2).alias("revenue"))


@register(
    "regex_filter",
    """SELECT p_partkey, p_type, round(sum(l_quantity), 2) AS qty
FROM part JOIN lineitem ON l_partkey = p_partkey
WHERE regexp_matches(p_type, '^(SMALL|LARGE)') AND regexp_matches(p_name, '(gear|bolt)$') GROUP BY 1, 2""",
)
def q_regex_filter(spark, sf):
    t = Tables(spark, sf)
    p = t.part.where(F.col("p_type").rlike("^(SMALL|LARGE)") & F.col("p_name").rlike("(gear|bolt)$"))
    j = p.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_partkey", "p_type").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@register(
    "na_omit",
    """SELECT * FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status, NULLIF(o_orderpriority, '5-LOW') AS priority FROM orders)
WHERE status IS NOT NULL AND priority IS NOT NULL""",
)
def q_na_omit(spark, sf):
    o = Tables(spark, sf).orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    )
    return o.na.drop(how="any")


@register(
    "not_in_null_safe",
    """SELECT o_orderkey, status FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status FROM orders)
WHERE NOT coalesce(status IN ('F'), false)""",
)
def q_not_in_null_safe(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return o.where(S.not_in_safe("status", ["F"]))


@register(
    "restrict_regions",
    f"""WITH {NY_SQL}
SELECT rgn_id, year, round(revenue, 2) AS revenue FROM ny
WHERE rgn_id IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA')) OR rgn_id = 0""",
)
def q_restrict_regions(spark, sf):
    t = Tables(spark, sf)
    keep = (
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .where(F.col("r_name").isin("AFRICA", "ASIA"))
        .select(F.col("n_nationkey").alias("rgn_id"))
        .unionByName(t.spark.range(1).select(F.lit(0).alias("rgn_id")))
        .distinct()
    )
    ny = nation_year_revenue(t)
    return ny.join(keep, "rgn_id", "left_semi").select("rgn_id", "year", F.round("revenue", 2).alias("revenue"))


_DM_SQL = f"""{OF_SQL}, a AS (SELECT year, o_custkey FROM of WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 499000)"""


@register(
    "double_membership",
    f"""WITH {_DM_SQL}
SELECT o_orderkey, o_custkey, year FROM of
WHERE NOT (year IN (SELECT year FROM a) AND o_custkey IN (SELECT o_custkey FROM a))""",
)
def q_double_membership(spark, sf):
    of = order_facts(Tables(spark, sf))
    a = J.once(of.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 499000)).select("year", "o_custkey"))
    out = FL.double_membership_exclude(of, a, [("year", "year"), ("o_custkey", "o_custkey")])
    return out.select("o_orderkey", "o_custkey", "year")


@register(
    "any_zero_keys",
    f"""WITH {OF_SQL}, s AS (SELECT o_custkey, year, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n FROM of GROUP BY 1, 2)
SELECT DISTINCT o_custkey FROM s WHERE n = 0""",
)
def q_any_zero_keys(spark, sf):
    of = order_facts(Tables(spark, sf))
    s = of.groupBy("o_custkey", "year").agg(F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("n"))
    return FL.any_member_keys(s, "o_custkey", F.col("n") == 0)


# ---------------------------------------------------------------- joins (J*) and set operations (U*)


_CY_SQL = """cy AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS revenue FROM orders GROUP BY 1, 2)"""


@register(
    "left_join",
    f"""WITH {_CY_SQL}
SELECT c_custkey, c_nationkey, y.year, round(revenue, 2) AS revenue
FROM customer CROSS JOIN (SELECT DISTINCT year FROM cy) y LEFT JOIN cy ON cy.o_custkey = c_custkey AND cy.year = y.year""",
)
def q_left_join(spark, sf):
    t = Tables(spark, sf)
    cy = J.once(t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), year_of("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("revenue")))
    grid = R.with_dimension(t.customer.select("c_custkey", "c_nationkey"), "year", R.present_values(cy, "year"))
    return grid.join(cy, ["c_custkey", "year"], "left").select("c_custkey", "c_nationkey", "year", F.round("revenue", 2).alias("revenue"))


_LJM_SQL = f"""{NY_SQL}, {LF_SQL}, s AS (SELECT s_nationkey AS rgn_id, year, sum(l_quantity) AS qty FROM lf WHERE l_returnflag = 'R' GROUP BY 1, 2)"""


def _ship_qty(t, flag="R"):
    lf = line_facts(t).where(F.col("l_returnflag") == flag)
    return lf.groupBy(F.col("s_nationkey").alias("rgn_id"), "year").agg(F.sum("l_quantity").alias("qty"))


@register(
    "left_join_multi",
    f"""WITH {_LJM_SQL}
SELECT ny.rgn_id, ny.year, round(revenue, 2) AS revenue, round(qty, 2) AS qty FROM ny LEFT JOIN s ON ny.rgn_id = s.rgn_id AND ny.year = s.year""",
)
def q_left_join_multi(spark, sf):
    t = Tables(spark, sf)
    j = nation_year_revenue(t).join(_ship_qty(t), ["rgn_id", "year"], "left")
    return j.select("rgn_id", "year", F.round("revenue", 2).alias("revenue"), F.round("qty", 2).alias("qty"))


@register(
    "inner_join_multi",
    f"""WITH {LF_SQL},
a AS (SELECT s_nationkey, year, l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lf GROUP BY 1, 2, 3, 4),
b AS (SELECT s_nationkey, year, l_returnflag, l_linestatus, avg(l_discount) AS disc FROM lf WHERE l_discount > 0.08 GROUP BY 1, 2, 3, 4)
SELECT a.s_nationkey, a.year, a.l_returnflag, a.l_linestatus, round(qty, 2) AS qty, round(disc, 6) AS disc
FROM a JOIN b ON a.s_nationkey = b.s_nationkey AND a.year = b.year AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus""",
)
def q_inner_join_multi(spark, sf):
    lf = line_facts(Tables(spark, sf))
    keys = ["s_nationkey", "year", "l_returnflag", "l_linestatus"]
    a = lf.groupBy(*keys).agg(F.sum("l_quantity").alias("qty"))
    b = lf.where(F.col("l_discount") > 0.08).groupBy(*keys).agg(F.avg("l_discount").alias("disc"))
    return a.join(b, keys, "inner").select(*keys, F.round("qty", 2).alias("qty"), r6("disc").alias("disc"))


_AREA_SQL = f"""{LF_SQL},
st AS (SELECT l_suppkey AS saup_id, year, avg(1 - l_discount) AS status_saup FROM lf GROUP BY 1, 2),
pa AS (SELECT s_suppkey AS saup_id, s_nationkey AS rgn_id,
              (s_acctbal + 1000) / sum(s_acctbal + 1000) OVER (PARTITION BY s_nationkey) AS prop_area FROM supplier)"""


@register(
    "area_share",
    f"""WITH {_AREA_SQL}
SELECT rgn_id, year, round(sum(status_saup * prop_area), 6) AS status FROM st JOIN pa USING (saup_id) GROUP BY 1, 2""",
)
def q_area_share(spark, sf):
    t = Tables(spark, sf)
    st = line_facts(t).groupBy(F.col("l_suppkey").alias("saup_id"), "year").agg(F.avg(1 - F.col("l_discount")).alias("status_saup"))
    area = t.supplier.select(F.col("s_suppkey").alias("saup_id"), F.col("s_nationkey").alias("rgn_id"), (F.col("s_acctbal") + 1000).alias("area"))
    pa = W.share_by_join(area, "area", "rgn_id", "prop_area")
    j = st.join(pa, "saup_id", "inner")
    return j.groupBy("rgn_id", "year").agg(r6(S.sum_strict(F.col("status_saup") * F.col("prop_area"))).alias("status"))


# the return flags R, A and any other cover the whole table; a part has no line of some flag in some year
_FJ_SQL = """pf AS (SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, sum(l_extendedprice) AS v, sum(l_quantity) AS q, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT l_partkey, year, v AS a FROM pf WHERE l_returnflag = 'R'),
b AS (SELECT l_partkey, year, q AS b FROM pf WHERE l_returnflag = 'A'),
c AS (SELECT l_partkey, year, CAST(sum(n) AS DOUBLE) AS c FROM pf WHERE l_returnflag NOT IN ('R', 'A') GROUP BY 1, 2)"""


def _fj_frames(t):
    li = t.lineitem.withColumn("year", year_of("l_shipdate"))
    flag = F.col("l_returnflag")
    of = lambda df, agg: df.groupBy("l_partkey", "year").agg(agg)
    return (
        of(li.where(flag == "R"), F.sum("l_extendedprice").alias("a")),
        of(li.where(flag == "A"), F.sum("l_quantity").alias("b")),
        of(li.where(~flag.isin("R", "A")), F.count(F.lit(1)).cast("double").alias("c")),
    )


@register(
    "full_join_chain",
    f"""WITH {_FJ_SQL}
SELECT l_partkey, year, round(a, 2) AS a, round(b, 2) AS b, c FROM a FULL JOIN b USING (l_partkey, year) FULL JOIN c USING (l_partkey, year)""",
)
def q_full_join_chain(spark, sf):
    j = J.full_join_chain(_fj_frames(Tables(spark, sf)), ["l_partkey", "year"], unique=True)
    return j.select("l_partkey", "year", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "c")


@register(
    "full_merge",
    f"""WITH {_FJ_SQL},
a2 AS (SELECT l_partkey, NULLIF(year, 1995) AS year, a FROM a),
c2 AS (SELECT l_partkey, NULLIF(year, 1995) AS year, c FROM c)
SELECT coalesce(a2.l_partkey, c2.l_partkey) AS l_partkey, coalesce(a2.year, c2.year) AS year, round(a, 2) AS a, c
FROM a2 FULL JOIN c2 ON a2.l_partkey = c2.l_partkey AND a2.year IS NOT DISTINCT FROM c2.year""",
)
def q_full_merge(spark, sf):
    a, _, c = _fj_frames(Tables(spark, sf))
    a2 = a.withColumn("year", F.nullif("year", F.lit(1995)))
    c2 = c.withColumn("year", F.nullif("year", F.lit(1995)))
    return J.full_merge(a2, c2).select("l_partkey", "year", F.round("a", 2).alias("a"), "c")


# fixed values: priority weights used by the lookup and multiplier queries (one priority deliberately absent)
PRIORITY_WEIGHTS = [("1-URGENT", 1.0), ("2-HIGH", 0.8), ("3-MEDIUM", 0.6), ("4-NOT SPECIFIED", 0.4)]
PRIORITY_VALUES_SQL = "(VALUES ('1-URGENT', 1.0), ('2-HIGH', 0.8), ('3-MEDIUM', 0.6), ('4-NOT SPECIFIED', 0.4)) AS pw(o_orderpriority, weight)"


@register(
    "lookup_join",
    f"""WITH {OF_SQL}
SELECT c_nationkey AS rgn_id, round(avg(weight), 6) AS score, count(weight) AS n_weighted
FROM of LEFT JOIN {PRIORITY_VALUES_SQL} USING (o_orderpriority) GROUP BY 1""",
)
def q_lookup_join(spark, sf):
    of = order_facts(Tables(spark, sf))
    pw = J.lookup_table(spark, PRIORITY_WEIGHTS, "o_orderpriority string, weight double")
    j = of.join(pw, "o_orderpriority", "left")
    return j.groupBy(F.col("c_nationkey").alias("rgn_id")).agg(r6(F.avg("weight")).alias("score"), F.count("weight").alias("n_weighted"))


@register(
    "optional_multiplier",
    f"""WITH {OF_SQL}
SELECT c_nationkey AS rgn_id, o_orderpriority, round(sum(o_totalprice * coalesce(weight, 1.0)), 4) AS xtr
FROM of LEFT JOIN {PRIORITY_VALUES_SQL} USING (o_orderpriority) GROUP BY 1, 2""",
)
def q_optional_multiplier(spark, sf):
    of = order_facts(Tables(spark, sf))
    pw = J.lookup_table(spark, PRIORITY_WEIGHTS, "o_orderpriority string, weight double")
    j = of.join(pw, "o_orderpriority", "left")
    return j.groupBy(F.col("c_nationkey").alias("rgn_id"), "o_orderpriority").agg(
        F.round(F.sum(F.col("o_totalprice") * F.coalesce("weight", F.lit(1.0))), 4).alias("xtr")
    )


@register("semi_join", "SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q_semi_join(spark, sf):
    t = Tables(spark, sf)
    k = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return J.semi_join(t.customer.select("c_custkey", "c_nationkey"), k, "c_custkey")


@register("anti_join", "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 45)")
def q_anti_join(spark, sf):
    t = Tables(spark, sf)
    k = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).select(F.col("l_partkey").alias("p_partkey"))
    return J.anti_join(t.part.select("p_partkey", "p_brand"), k, "p_partkey")


@register(
    "unmatched_keys",
    "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
)
def q_unmatched_keys(spark, sf):
    t = Tables(spark, sf)
    look = t.supplier.where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("l_suppkey"))
    return J.unmatched_keys(t.lineitem, look, ["l_suppkey"])


@register(
    "key_union",
    """SELECT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000
UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""",
)
def q_key_union(spark, sf):
    t = Tables(spark, sf)
    a = t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000)).select(F.col("o_custkey").alias("c_custkey"))
    b = t.customer.where(F.col("c_acctbal") < 0).select("c_custkey")
    return a.unionByName(b).distinct()


# fixed values: display-name multipliers; two names match no nation (the reference's travel-warning case)
NAME_MULTIPLIERS = [("NATION_3", 0.25), ("NATION_7", 0.5), ("NATION_11", 0.75), ("Nepal", 0.5), ("Republic of South Sudan", 0.25)]
NAME_VALUES_SQL = "(VALUES ('NATION_3', 0.25), ('NATION_7', 0.5), ('NATION_11', 0.75), ('Nepal', 0.5), ('Republic of South Sudan', 0.25)) AS tw(rgn_name, multiplier)"


@register(
    "name_join",
    f"""WITH {NY_SQL}, m AS (SELECT n_nationkey AS rgn_id, multiplier FROM {NAME_VALUES_SQL} LEFT JOIN nation ON n_name = rgn_name WHERE n_nationkey IS NOT NULL)
SELECT ny.rgn_id, year, round(CASE WHEN multiplier IS NOT NULL THEN multiplier * revenue ELSE revenue END, 4) AS xtr
FROM ny LEFT JOIN m ON ny.rgn_id = m.rgn_id""",
)
def q_name_join(spark, sf):
    t = Tables(spark, sf)
    tw = J.lookup_table(spark, NAME_MULTIPLIERS, "rgn_name string, multiplier double")
    m = tw.join(t.nation, F.col("n_name") == F.col("rgn_name"), "left").where(F.col("n_nationkey").isNotNull())
    m = m.select(F.col("n_nationkey").alias("rgn_id"), "multiplier")
    j = nation_year_revenue(t).join(m, "rgn_id", "left")
    return j.select("rgn_id", "year", F.round(F.coalesce(F.col("multiplier") * F.col("revenue"), F.col("revenue")), 4).alias("xtr"))


@register(
    "union_all",
    f"""WITH {NY_SQL}
SELECT rgn_id AS region_id, 'status' AS dimension, round(revenue / n_orders / 1000, 6) AS score FROM ny WHERE year = 2000
UNION ALL
SELECT rgn_id, 'trend', round(regr_slope(revenue / n_orders / 1000.0, year) * 5, 6) FROM ny GROUP BY rgn_id""",
)
def q_union_all(spark, sf):
    ny = J.once(nation_year_revenue(Tables(spark, sf)))
    st = ny.where(F.col("year") == 2000).select(
        F.col("rgn_id").alias("region_id"), F.lit("status").alias("dimension"), r6(F.col("revenue") / F.col("n_orders") / 1000).alias("score")
    )
    tr = ny.groupBy(F.col("rgn_id").alias("region_id")).agg(
        F.lit("trend").alias("dimension"), r6(S.trend_slope(F.col("revenue") / F.col("n_orders") / 1000.0, "year")).alias("score")
    )
    return st.unionByName(tr)


# ---------------------------------------------------------------- reshape (R*)

_YL_SQL = f"""{OF_SQL}, s AS (SELECT c_mktsegment, 'y' || year AS yl, sum(o_totalprice) AS revenue FROM of GROUP BY 1, 2)"""


def _segment_years(t):
    of = order_facts(t).withColumn("yl", F.concat(F.lit("y"), F.col("year").cast("string")))
    return of.groupBy("c_mktsegment", "yl").agg(F.sum("o_totalprice").alias("revenue"))


@register("pivot", f"SELECT * FROM (PIVOT (WITH {_YL_SQL} SELECT c_mktsegment, yl, round(revenue, 2) AS revenue FROM s) ON yl USING max(revenue) GROUP BY c_mktsegment)")
def q_pivot(spark, sf):
    s = _segment_years(Tables(spark, sf)).withColumn("revenue", F.round("revenue", 2))
    return R.pivot(s, ["c_mktsegment"], "yl", None, "revenue", agg="max")


@register(
    "unpivot",
    f"""WITH {_YL_SQL}
SELECT k.c_mktsegment, y.yl AS year_label, round(revenue, 2) AS revenue
FROM (SELECT DISTINCT c_mktsegment FROM s) k CROSS JOIN (SELECT DISTINCT yl FROM s) y LEFT JOIN s ON s.c_mktsegment = k.c_mktsegment AND s.yl = y.yl""",
)
def q_unpivot(spark, sf):
    p = R.pivot(_segment_years(Tables(spark, sf)), ["c_mktsegment"], "yl", None, "revenue", agg="max")
    u = R.unpivot(p, ["c_mktsegment"], [c for c in p.columns if c != "c_mktsegment"], "year_label", "revenue")
    return u.select("c_mktsegment", "year_label", F.round("revenue", 2).alias("revenue"))


@register(
    "pivot_multi_key",
    """SELECT * FROM (PIVOT (SELECT o_custkey, o_orderstatus || '_' || replace(o_orderpriority, ' ', '_') AS pk FROM orders) ON pk USING count(*) GROUP BY o_custkey)""",
)
def q_pivot_multi_key(spark, sf):
    pk = F.concat_ws("_", "o_orderstatus", F.replace("o_orderpriority", F.lit(" "), F.lit("_"))).alias("pk")
    n = Tables(spark, sf).orders.groupBy("o_custkey", pk).agg(F.count(F.lit(1)).alias("n"))
    return R.pivot(n, ["o_custkey"], "pk", None, "n", agg="max").na.fill(0)


@register(
    "split_columns",
    """SELECT p_partkey, split_part(p_brand, '#', 1) AS brand_prefix, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_no,
       split_part(p_name, ' ', 1) AS adjective, split_part(p_name, ' ', 2) AS noun, sum(l_quantity) AS qty
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL""",
)
def q_split_columns(spark, sf):
    t = Tables(spark, sf)
    p = R.split_columns(t.part, "p_brand", ["brand_prefix", "brand_no"], "#")
    p = R.split_columns(p, "p_name", ["adjective", "noun"], " ").withColumn("brand_no", F.col("brand_no").cast("int"))
    j = p.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_partkey", "brand_prefix", "brand_no", "adjective", "noun").agg(F.sum("l_quantity").alias("qty"))


@register(
    "risk_table",
    f"""WITH {OF_SQL},
k AS (SELECT DISTINCT c_nationkey AS rgn_id FROM of),
orn AS (SELECT DISTINCT c_nationkey AS rgn_id, CAST(1.0 AS DOUBLE) AS ornamentals FROM of WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000),
w AS (SELECT k.rgn_id, CAST(1.0 AS DOUBLE) AS corals, CAST(0.0 AS DOUBLE) AS sponges, CAST(0.0 AS DOUBLE) AS shells,
             coalesce(ornamentals, CAST(0.0 AS DOUBLE)) AS ornamentals FROM k LEFT JOIN orn USING (rgn_id))
SELECT rgn_id, product, risk FROM w UNPIVOT (risk FOR product IN (corals, sponges, shells, ornamentals))""",
)
def q_risk_table(spark, sf):
    of = order_facts(Tables(spark, sf))
    k = of.select(F.col("c_nationkey").alias("rgn_id")).distinct()
    orn = (
        of.where((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000))
        .select(F.col("c_nationkey").alias("rgn_id"))
        .distinct()
        .withColumn("ornamentals", F.lit(1.0))
    )
    w = k.join(orn, "rgn_id", "left").select(
        "rgn_id", F.lit(1.0).alias("corals"), F.lit(0.0).alias("sponges"), F.lit(0.0).alias("shells"),
        F.coalesce("ornamentals", F.lit(0.0)).alias("ornamentals"),
    )
    return R.unpivot(w, ["rgn_id"], ["corals", "sponges", "shells", "ornamentals"], "product", "risk")


# ---------------------------------------------------------------- projection and derivation (P*)


_CP_SQL = """cp AS (SELECT o_custkey, o_orderpriority, avg(ln(o_totalprice)) AS v FROM orders GROUP BY 1, 2)"""


def _customer_priorities(t):
    """Wide: one column per priority that occurs; a customer without an order of a priority has a NULL there."""
    v = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.avg(F.ln("o_totalprice")).alias("v"))
    wide = R.pivot(v, ["o_custkey"], "o_orderpriority", None, "v", agg="max")
    return wide, [f"`{c}`" for c in wide.columns if c != "o_custkey"]


@register("row_mean", f"WITH {_CP_SQL} SELECT o_custkey, round(avg(v), 6) AS score FROM cp GROUP BY 1")
def q_row_mean(spark, sf):
    wide, cols = _customer_priorities(Tables(spark, sf))
    return wide.select("o_custkey", r6(S.row_mean(*cols)).alias("score"))


@register("row_sum", f"WITH {_CP_SQL} SELECT o_custkey, round(sum(v), 6) AS score FROM cp GROUP BY 1")
def q_row_sum(spark, sf):
    wide, cols = _customer_priorities(Tables(spark, sf))
    return wide.select("o_custkey", r6(S.row_sum(*cols)).alias("score"))


@register(
    "piecewise_score",
    """WITH r AS (SELECT l_partkey, avg(l_quantity) / 25.0 AS ratio FROM lineitem GROUP BY 1)
SELECT l_partkey, round(ratio, 6) AS ratio,
       round(CASE WHEN ratio < 0.95 THEN ratio WHEN ratio > 1.05 THEN
             CASE WHEN 1 - 0.5 * (ratio - 1.05) > 0.25 THEN 1 - 0.5 * (ratio - 1.05) ELSE 0.25 END ELSE 1.0 END, 6) AS score
FROM r""",
)
def q_piecewise_score(spark, sf):
    r = Tables(spark, sf).lineitem.groupBy("l_partkey").agg((F.avg("l_quantity") / 25.0).alias("ratio"))
    return r.select("l_partkey", r6("ratio").alias("ratio"), r6(S.piecewise_score("ratio")).alias("score"))


@register(
    "rescale",
    f"""WITH {LF_SQL} SELECT s_nationkey AS rgn_id, round((avg(l_tax * 75 + 1) - 1) / (7 - 1), 6) AS s FROM lf GROUP BY 1""",
)
def q_rescale(spark, sf):
    lf = line_facts(Tables(spark, sf))
    return lf.groupBy(F.col("s_nationkey").alias("rgn_id")).agg(r6(S.rescale(F.avg(F.col("l_tax") * 75 + 1), 1, 7)).alias("s"))


# fixed values: segment recode (unmapped segments pass through)
SEGMENT_RECODE = {"AUTOMOBILE": "AUTO", "HOUSEHOLD": "HOME"}


@register(
    "recode",
    """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTO' WHEN 'HOUSEHOLD' THEN 'HOME' ELSE c_mktsegment END AS segment,
       count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def q_recode(spark, sf):
    of = order_facts(Tables(spark, sf))
    return of.groupBy(S.recode("c_mktsegment", SEGMENT_RECODE).alias("segment")).agg(F.count(F.lit(1)).alias("n_orders"))


@register(
    "coalesce_formula",
    f"""WITH {OF_SQL}, m AS (
  SELECT c_nationkey AS rgn_id, year,
         CASE WHEN year <= 1996 THEN count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) END AS ep,
         CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS ed,
         CAST(count(*) AS DOUBLE) AS l,
         count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS u
  FROM of GROUP BY 1, 2)
SELECT rgn_id, year, round(coalesce(ep, ed / NULLIF(l - l * u, 0)), 6) AS e FROM m""",
)
def q_coalesce_formula(spark, sf):
    of = order_facts(Tables(spark, sf))
    n = F.count(F.lit(1))
    urgent = F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1))
    m = of.groupBy(F.col("c_nationkey").alias("rgn_id"), "year").agg(
        F.when(F.col("year") <= 1996, urgent / n).alias("ep"),
        urgent.cast("double").alias("ed"),
        n.cast("double").alias("l"),
        (F.count(F.when(F.col("o_orderstatus") == "F", 1)) / n).alias("u"),
    )
    e = F.coalesce(F.col("ep"), S.safe_div("ed", F.col("l") - F.col("l") * F.col("u")))
    return m.select("rgn_id", "year", r6(e).alias("e"))


@register(
    "nullify_keys",
    f"""WITH {NY_SQL}, k AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT rgn_id, year, CASE WHEN rgn_id IN (SELECT n_nationkey FROM k) THEN NULL ELSE round(revenue, 2) END AS revenue FROM ny""",
)
def q_nullify_keys(spark, sf):
    t = Tables(spark, sf)
    k = (
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .where(F.col("r_name") == "ASIA")
        .select(F.col("n_nationkey").alias("rgn_id"), F.lit(True).alias("hit"))
    )
    j = nation_year_revenue(t).join(k, "rgn_id", "left")
    return j.select("rgn_id", "year", F.when(F.col("hit"), None).otherwise(F.round("revenue", 2)).alias("revenue"))


@register(
    "string_scalars",
    """SELECT p_partkey, concat_ws('_', p_brand, p_type) AS stock_id, substring(p_brand, 7, 1) AS brand_digit,
       regexp_replace(p_name, '^(\\w+) (\\w+)$', '\\2-\\1') AS swapped, lower(p_type) AS type_lc,
       length(regexp_replace(p_name, '[^ ]', '', 'g')) AS n_spaces, printf('%.1f %s (%s)', p_size / 10.0, p_type, p_brand) AS label,
       p_type LIKE 'S%' AS starts_s
FROM part""",
)
def q_string_scalars(spark, sf):
    p = Tables(spark, sf).part
    return p.select(
        "p_partkey",
        F.concat_ws("_", "p_brand", "p_type").alias("stock_id"),
        F.substring("p_brand", 7, 1).alias("brand_digit"),
        F.regexp_replace("p_name", r"^(\w+) (\w+)$", "$2-$1").alias("swapped"),
        F.lower("p_type").alias("type_lc"),
        F.regexp_count("p_name", F.lit(" ")).cast("bigint").alias("n_spaces"),
        F.format_string("%.1f %s (%s)", F.col("p_size") / 10.0, "p_type", "p_brand").alias("label"),
        F.col("p_type").startswith("S").alias("starts_s"),
    )
