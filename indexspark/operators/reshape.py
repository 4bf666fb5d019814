"""Reshape operators (R1-R6) and grid completion.

Grids come from the distinct values of a dimension (years, products) or a literal list. The values present are one
array from a scalar subquery, attached with ``explode``: no cross join of data is planned, nothing reaches the driver
and no number of values is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def present_values(df: DataFrame, col: str) -> Column:
    """The distinct non-null values of a dimension column, ascending, as an array from a scalar subquery."""
    return df.select(col).distinct().agg(F.sort_array(F.collect_set(col)).alias("values")).scalar()


def literal_array(values: Sequence, cast: str | None = None) -> Column:
    arr = F.array(*[F.lit(v) for v in values]) if values else F.array()
    return arr.cast(f"array<{cast}>") if cast else arr


def with_dimension(df: DataFrame, name: str, values: Sequence | Column, cast: str | None = None) -> DataFrame:
    """Repeat every row once per value of a dimension (``expand.grid`` column): a list, or an array column."""
    return df.withColumn(name, F.explode(values if isinstance(values, Column) else literal_array(values, cast)))


def complete_series(df: DataFrame, keys: Sequence[str], over: str, values: Sequence | None = None,
                    materialize: bool = False) -> DataFrame:
    """Every distinct key tuple x every value of ``over`` (default: the values present), facts left joined.

    Equivalent to tidyr ``spread`` + ``gather`` / ``expand.grid`` + ``left_join``. The input is read three times
    (dimension values, key grid, facts); with ``materialize`` it is stored first, so an aggregate of a large
    table is computed once instead of re-planned from its scan three times.
    """
    if materialize:
        df = stored(df, "grid")
    if values is None:
        values = present_values(df, over)
    dtype = dict(df.dtypes)[over]
    grid = with_dimension(df.select(*keys).distinct(), over, values, dtype)
    return grid.join(df, on=[*keys, over], how="left")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str, cast: str = "double") -> DataFrame:
    """Wide to long (``gather``/``melt``); value columns are cast to one type first."""
    wide = df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in values])
    return wide.unpivot(list(ids), list(values), var, val)


#: Most columns that values found in the data may become; beyond it a pivot is refused rather than cut.
MOST_COLUMNS = 10_000


def found_values(df: DataFrame, column: str) -> list:
    """The distinct non-null values of a column, ascending, on the driver: they are to become column names.

    Their number is checked in the same job. Each value is counted once a task before any shuffle.
    """
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n")).limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} values, too many for columns; use pivot_map")
    return sorted(r[0] for r in rows)


def pivot(df: DataFrame, index: Sequence[str], column: str, values: Sequence | None, value_col: str, agg: str = "first") -> DataFrame:
    """Long to wide (``spread``/``dcast``); the columns are ``values``, or with None all values that occur.

    ``df`` is aggregated on index and column before values are looked for, so that a large table is read once: with
    None the aggregate is stored, and both the discovery and the pivot read the stored rows.
    """
    fn = {"first": lambda c: F.first(c, ignorenulls=False), "sum": F.sum, "avg": F.avg, "max": F.max}[agg]
    if values is None:
        df = stored(df.groupBy(*index, column).agg(fn(F.col(value_col)).alias(value_col)), "pivot")
        fn, values = F.max, found_values(df, column)
        if not values:
            return df.select(*index).distinct()
    return df.groupBy(*index).pivot(column, list(values)).agg(fn(F.col(value_col)))


def pivot_map(df: DataFrame, index: Sequence[str], column: str, value_col: str, name: str = "values") -> DataFrame:
    """R2 for a column of any number of values: one map value -> ``value_col`` per index row, its keys ascending.

    ``df`` has one row per index and value (aggregate first; a repeated one is refused by the map).
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(column), F.col(value_col))))
    return df.where(F.col(column).isNotNull()).groupBy(*index).agg(F.map_from_entries(pairs).alias(name))


def split_columns(df: DataFrame, col: str, names: Sequence[str], sep: str) -> DataFrame:
    """``separate(col, names, sep)``; missing pieces are NULL (``fill='right'``)."""
    parts = F.split(F.col(col), sep)
    out = df
    for i, n in enumerate(names):
        out = out.withColumn(n, F.get(parts, i))
    return out.drop(col) if col not in names else out


def explode_targets(df: DataFrame, col: str, out: str, sep: str = " ", max_parts: int | None = None) -> DataFrame:
    """H1: space-separated multi-valued column to one row per value: all of them, or the first ``max_parts``."""
    parts = F.split(F.col(col), sep)
    parts = parts if max_parts is None else F.slice(parts, 1, max_parts)
    return df.withColumn(out, F.explode(parts)).filter(F.col(out).isNotNull() & (F.col(out) != ""))
