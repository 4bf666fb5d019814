"""One test per NA rule N1-N18 on hand-made mini fixtures."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from indexspark.functions import semantics as S
from indexspark.operators import joins as J
from indexspark.operators import windows as W


def one(df, expr):
    return df.select(expr.alias("v")).collect()[0]["v"]


def agg(df, expr):
    return df.agg(expr.alias("v")).collect()[0]["v"]


def test_n1_ifelse_na(spark):
    df = spark.createDataFrame([(None,), (True,), (False,)], "c boolean")
    got = [r.v for r in df.select(S.r_ifelse("c", F.lit(1), F.lit(2)).alias("v")).collect()]
    assert got == [None, 1, 2]


def test_n2_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,), (0.5,)], "x double")
    got = [r.v for r in df.select(S.clamp("x", -1.0, 1.0).alias("v")).collect()]
    assert got == [None, 1.0, -1.0, 0.5]


def test_n3_not_in_keeps_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    assert sorted(r.x or "" for r in df.where(S.not_in_safe("x", ["a"])).collect()) == ["", "b"]


def test_n4_filter_drops_na(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert df.where(F.col("x") > 0).count() == 2


def test_n5_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, a int")
    b = spark.createDataFrame([(None, 10), (2, 20)], "k int, b int")
    got = sorted(((r.k if r.k is not None else -1), r.b) for r in J.join_null_safe(a, b, ["k"], "inner").collect())
    assert got == [(-1, 10), (2, 20)]
    full = J.full_merge(a, b)
    assert full.count() == 2


def test_n6_nan_is_na(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert agg(df, F.avg(S.nan_to_null("x"))) == 2.0
    assert math.isnan(agg(df, F.avg("x")))


def test_n7_divide_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (4.0, 2.0)], "a double, b double")
    assert [r.v for r in df.select(S.safe_div("a", "b").alias("v")).collect()] == [None, None, 2.0]


def test_n8_empty_sum_is_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert agg(df, S.sum0("x")) == 0.0


def test_n9_empty_mean_is_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert agg(df, F.avg("x")) is None


def test_n10_round_half_even(spark):
    df = spark.range(1)
    assert one(df, S.r_round(F.lit(2.5), 0)) == 2.0
    assert one(df, S.r_round(F.lit(3.5), 0)) == 4.0
    assert one(df, S.r_round(F.lit(0.125), 2)) == 0.12


def test_n11_quantile_type7(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert abs(agg(df, S.quantile("x", 0.9)) - 7.9) < 1e-9


def test_n12_one_year_trend_is_null(spark):
    df = spark.createDataFrame([(2000, 1.0), (2000, 2.0)], "year int, y double")
    assert agg(df, S.trend_slope("y", "year")) is None
    df2 = spark.createDataFrame([(2000, 1.0), (2001, 2.0), (2002, None)], "year int, y double")
    assert abs(agg(df2, S.trend_slope("y", "year")) - 5.0) < 1e-9


def test_n13_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, None)], "x double, w double")
    assert agg(df, S.weighted_mean("x", "w")) is None  # NA weight with na.rm -> NA
    df2 = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (3.0, 3.0)], "x double, w double")
    assert agg(df2, S.weighted_mean("x", "w")) == 2.5  # NA x dropped
    assert agg(df2, S.weighted_mean("x", "w", na_rm=False)) is None
    df3 = spark.createDataFrame([(1.0, 1.0), (None, 0.0)], "x double, w double")
    assert agg(df3, S.weighted_mean("x", "w", na_rm=False)) == 1.0  # zero weight hides NA x
    df4 = spark.createDataFrame([(1.0, 0.0)], "x double, w double")
    assert agg(df4, S.weighted_mean("x", "w")) is None  # sum of weights 0


def test_n14_geometric_mean_with_zero(spark):
    df = spark.createDataFrame([(0.0,), (4.0,)], "x double")
    assert agg(df, S.geo_mean("x")) == 0.0
    df2 = spark.createDataFrame([(1.0,), (4.0,), (None,)], "x double")
    assert abs(agg(df2, S.geo_mean("x")) - 2.0) < 1e-12
    negative = df.sparkSession.createDataFrame([(0.8,), (0.5,), (-0.1,)], "x double")  # a pressure above 1
    assert abs(agg(negative, S.geo_mean("x")) - 0.4**0.5) < 1e-12
    df3 = spark.createDataFrame([(0.0, 0.5), (2.0, 0.5)], "s double, w double")
    assert agg(df3, S.geo_wmean("s", "w")) == 0.0


def test_n15_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(1, 2001), (1, 2001), (1, 2000), (1, 1999)], "k int, year int")
    kept = df.withColumn("keep", W.top_n_ties("year", "k", 1)).where("keep")
    assert kept.count() == 2


def test_n16_latest_may_be_null(spark):
    df = spark.createDataFrame([(1, 2000, 5.0), (1, 2001, None)], "k int, year int, v double")
    assert agg(df, S.latest("v", "year")) is None


def test_n17_centred_rolling_window(spark):
    df = spark.range(1, 7).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("t"), F.col("id").cast("double").alias("x"))
    got = [r.m for r in df.select(W.rolling_mean_centred("x", "k", "t", 4).alias("m")).orderBy("m").collect()]
    assert got == [2.0, 2.5, 3.5, 4.5, 5.0, 5.5]


def test_n18_strict_aggregates(spark):
    df = spark.createDataFrame([(2.0,), (None,), (8.0,)], "x double")
    assert agg(df, S.sum_strict("x")) is None
    assert agg(df, S.mean_strict("x")) is None
    assert agg(df, S.strict(F.product("x"), "x")) is None
    assert agg(df, F.sum("x")) == 10.0


def test_row_mean_and_sum(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    got = df.select(S.row_mean("a", "b", "c").alias("m"), S.row_sum("a", "b", "c").alias("s")).collect()
    assert (got[0].m, got[0].s) == (2.0, 4.0)
    assert (got[1].m, got[1].s) == (None, 0.0)


def test_piecewise_score(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (4.0,), (None,)], "x double")
    got = [r.v for r in df.select(S.piecewise_score("x").alias("v")).collect()]
    assert got[0] == 0.5 and got[1] == 1.0 and abs(got[2] - 0.775) < 1e-12 and got[3] == 0.25 and got[4] is None


def test_concat_members_sorted_and_empty(spark):
    df = spark.createDataFrame([("g", "b", 1.0), ("g", "a", None), ("g", "c", 2.0)], "g string, k string, w double")
    r = df.groupBy("g").agg(S.concat_members("k", F.col("w").isNotNull()).alias("x"),
                            S.concat_members("k", F.col("w") > 5).alias("y")).collect()[0]
    assert r.x == "b,c" and r.y == ""


def test_window_share_partitioned(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 0.0)], "k int, x double")
    got = sorted((r.k, r.s) for r in df.select("k", W.share_of_total("x", "k").alias("s")).collect())
    assert got == [(1, 0.25), (1, 0.75), (2, None)]


def test_global_row_number_is_dense_and_ordered(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("v"))
    out = W.global_row_number(df, ["v"], "rn", partitions=4)
    got = [(r.v, r.rn) for r in out.orderBy("rn").collect()]
    assert [rn for _, rn in got] == list(range(1, 501))
    assert [v for v, _ in got] == sorted(v for v, _ in got)
    assert Window is not None
