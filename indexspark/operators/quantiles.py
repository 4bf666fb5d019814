"""Exact type-7 quantiles of raw groups of any size.

``percentile`` keeps all values of a group in one task, which suits aggregated series. Here ranks are selected by
histogram refinement: each round counts a group's values in BINS intervals between two bounds (partial counts in every
task, so at most BINS rows a group, rank and task are shuffled), finds the interval that holds the wanted rank and takes
its least and greatest value as the next bounds. It ends when these are equal or few values lie between them, which are
then sorted. A group of all rows costs some scans, never a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BINS = 1024
#: So many values of a group are sorted in one row at the end.
FEW = 2048
_GREATEST = 1.7976931348623157e308


def _bin(v: Column, low: Column, high: Column) -> Column:
    """The interval of a value; halves keep the width of the widest range finite. Not decreasing in ``v``."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int"))).otherwise(0)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``keys`` and one column per quantile. NULL and NaN do not count; a group without values has NULLs; infinite values
    count as the greatest numbers. NULL keys form a group. Without ``keys`` the result is one row."""
    keys = list(keys)
    v = F.col(value).cast("double")
    held = F.greatest(F.least(v, F.lit(_GREATEST)), F.lit(-_GREATEST))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("__all"))
    rows = df.select(key.alias("__key"), F.when(v.isNotNull() & ~F.isnan(v), held).alias("__v"))
    groups = stored(rows.groupBy("__key").agg(F.count("__v").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")), "quantile-groups")
    # the two neighbouring ranks of each quantile, counted from 0: the bounds of the search for each
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(p)).cast("long"), F.least(F.floor(at(p)).cast("long") + 1, F.col("n") - 1)) for p in probs])))
    targets = groups.where("n > 0").select("__key", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    targets = stored(targets, "quantile-ranks")
    done = []
    while True:
        open_ = targets.where((F.col("low") < F.col("high")) & (F.col("inside") > FEW))
        done.append(targets.where((F.col("low") >= F.col("high")) | (F.col("inside") <= FEW)))
        if open_.isEmpty():
            break
        counts = _met(rows, open_).groupBy("__key", "rank", "before", _bin(F.col("__v"), F.col("low"), F.col("high")).alias("bin")).agg(
            F.count(F.lit(1)).alias("inside"), F.min("__v").alias("low"), F.max("__v").alias("high")
        )
        up_to = F.sum("inside").over(Window.partitionBy("__key", "rank").orderBy("bin")) + F.col("before")
        found = counts.withColumn("up_to", up_to).where((F.col("up_to") > F.col("rank")) & (F.col("up_to") - F.col("inside") <= F.col("rank")))
        targets = stored(found.select("__key", "rank", "low", "high", (F.col("up_to") - F.col("inside")).alias("before"), "inside"), "quantile-ranks")
    known = done[0]
    for d in done[1:]:
        known = known.unionByName(d)
    known = stored(known, "quantile-known")
    few = _met(rows, known.where("low < high")).groupBy("__key", "rank", "before").agg(F.sort_array(F.collect_list("__v")).alias("values"))
    few = few.select("__key", "rank", F.element_at("values", (F.col("rank") - F.col("before") + 1).cast("int")).alias("x"))
    values = known.where("low >= high").select("__key", "rank", F.col("low").alias("x")).unionByName(few)
    by_rank = values.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x"))
    out = _null_safe_join(groups.select("__key", "n"), by_rank)

    def quantile(p: float) -> Column:
        lower = F.floor(at(p)).cast("long")
        a, b = F.element_at("x", lower), F.element_at("x", F.least(lower + 1, F.col("n") - 1))
        share = at(p) - lower
        return F.when(F.col("n") > 0, a + share * (b - a))

    return out.select(*[F.col(f"__key.{k}").alias(k) for k in keys], *[quantile(p).alias(n) for p, n in zip(probs, names, strict=True)])


def _null_safe_join(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.withColumnRenamed("__key", "__other")
    return a.join(other, F.col("__key").eqNullSafe(F.col("__other")), "left").drop("__other")


def _met(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each value with the targets of its group between whose bounds it lies. A group has a row in ``targets`` for each
    rank; the join is on the group, and adaptive execution splits a large group or broadcasts the targets."""
    t = targets.withColumnRenamed("__key", "__of")
    inside = (F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high"))
    return rows.where("__v is not null").join(t, F.col("__key").eqNullSafe(F.col("__of")) & inside).drop("__of")
