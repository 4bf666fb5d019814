"""Window operators (W1-W7; W8 id order is ``global_row_number``).

Windows are meant for partitions of *already aggregated* rows (a region's years, a product's regions); over raw rows
``share_by_join`` and ``keep_top_n_ties`` aggregate first, so a hot key does not put its raw rows into one task. No global (unpartitioned) window
over facts is used anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import nan_to_null, safe_div
from ..session import stored


def _w(part: Sequence[str] | str):
    return Window.partitionBy(*([part] if isinstance(part, str) else part))


def share_of_total(x: str | Column, part) -> Column:
    """``x / sum(x)`` within the partition."""
    x = F.col(x) if isinstance(x, str) else x
    return safe_div(x, F.sum(x).over(_w(part)))


def share_by_join(df: DataFrame, x: str, part: str, name: str) -> DataFrame:
    """W1 over raw rows: the totals are aggregated (map-side first) and joined back, so that no task holds a whole
    partition; the totals have one row per partition."""
    totals = df.groupBy(part).agg(F.sum(x).alias("__total"))
    return df.join(totals, part, "left").withColumn(name, safe_div(x, "__total")).drop("__total")


def rolling_mean_centred(x: str, part, order: str, width: int = 4) -> Column:
    """Centred partial rolling mean ignoring NA; even width ``w`` spans ``-(w//2-1) .. w//2``."""
    before = (width - 1) // 2
    after = width // 2
    return F.avg(nan_to_null(F.col(x))).over(_w(part).orderBy(order).rowsBetween(-before, after))


def cumsum(x: str, part, order: str) -> Column:
    """Running sum in ``order`` within the partition."""
    return F.sum(x).over(_w(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def peak_reference(x: str, part, factor: float) -> Column:
    """``factor * max(x, na.rm=TRUE)`` within the partition."""
    return F.lit(factor) * F.max(nan_to_null(F.col(x))).over(_w(part))


def mean_gapfill(df: DataFrame, x: str, part, flag: str | None = None, flag_value: str = "mean_gapfill") -> DataFrame:
    """Fill NA with the partition mean (``na.rm``), optionally flagging the filled rows."""
    m = F.avg(nan_to_null(F.col(x))).over(_w(part))
    if flag:
        df = df.withColumn(flag, F.when(F.col(x).isNull(), F.lit(flag_value)).otherwise(F.lit("0")))
    return df.withColumn(x, F.coalesce(F.col(x), m))


def count_in(part) -> Column:
    """``n()`` of the partition."""
    return F.count(F.lit(1)).over(_w(part))


def top_n_ties(order: str, part, n: int) -> Column:
    """``top_n(n, order)`` keeps ties: ``rank() <= n`` by descending order."""
    return F.rank().over(_w(part).orderBy(F.col(order).desc())) <= n


def keep_top_n_ties(df: DataFrame, order: str, part: str, n: int) -> DataFrame:
    """W7 over raw rows: the rows that ``top_n_ties`` keeps. Rows are counted per key and order value, the rank of a
    value is one more than the rows above it, and the kept values select the rows, so the window sees counts only."""
    above = _w(part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(part, order).agg(F.count(F.lit(1)).alias("__n"))
    kept = counts.withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0))).where(F.col("__above") < n)
    kept = kept.select(F.col(part).alias("__part"), F.col(order).alias("__order"))
    return df.join(kept, F.col(part).eqNullSafe(F.col("__part")) & F.col(order).eqNullSafe(F.col("__order")), "left_semi")


def global_row_number(df: DataFrame, order: Sequence[str], name: str = "rn", partitions: int | None = None) -> DataFrame:
    """A 1-based row number over the whole frame in ``order`` without a single-partition window.

    Rows are range partitioned on the order keys, numbered within their partition, and shifted by the row counts of
    all earlier partitions (a table with one row per partition). The numbered frame is stored first so the sampled range
    bounds are fixed between the count and the numbering.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = (
        df.repartitionByRange(n, *order)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__lr", F.row_number().over(Window.partitionBy("__pid").orderBy(*order)))
    )
    local = stored(local, "numbered")
    counts = local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid", (F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))).alias("__off")
    )
    return (
        local.join(F.broadcast(offsets), "__pid")
        .withColumn(name, (F.coalesce("__off", F.lit(0)) + F.col("__lr")).cast("long"))
        .drop("__pid", "__lr", "__off")
    )
