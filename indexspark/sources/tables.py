"""Readers for the driver tables (one Parquet file each) and shared derived facts.

Readers only declare scans; Catalyst prunes columns and pushes filters into each Parquet scan. Derived facts are
lazy DataFrames: every query that uses them re-plans them with its own projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


class Tables:
    """``Tables(spark, sf_dir).lineitem`` -> DataFrame over ``{sf_dir}/lineitem.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str, materialize_shared: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # whether shared pre-aggregates built from these tables are materialised once (see sources/proxy.py)
        self.materialize_shared = materialize_shared

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def year_of(col: str):
    return F.year(F.col(col)).cast("int")


def order_facts(t: Tables) -> DataFrame:
    """Orders with the customer's nation and segment and the order year."""
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return o.join(c, o.o_custkey == c.c_custkey).withColumn("year", year_of("o_orderdate"))


def line_facts(t: Tables) -> DataFrame:
    """Line items with the supplier's nation and the ship year."""
    s = t.supplier.select("s_suppkey", "s_nationkey")
    li = t.lineitem
    return li.join(s, li.l_suppkey == s.s_suppkey).withColumn("year", year_of("l_shipdate"))


def nation_year_revenue(t: Tables) -> DataFrame:
    """(rgn_id = customer nation, year) -> revenue, n_orders: the workhorse proxy series.

    Orders are pre-aggregated per (customer, year) before the customer join: the map-side partial aggregate collapses
    a customer holding any share of the orders to one row per task and year, so neither the join nor the final
    aggregate sees a hot key.
    """
    pre = t.orders.groupBy("o_custkey", year_of("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n_orders")
    )
    c = t.customer.select("c_custkey", "c_nationkey")
    return (
        pre.join(c, pre.o_custkey == c.c_custkey)
        .groupBy(F.col("c_nationkey").alias("rgn_id"), "year")
        .agg(F.sum("revenue").alias("revenue"), F.sum("n_orders").alias("n_orders"))
    )
