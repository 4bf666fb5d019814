"""Filter operators (F1-F8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_window(year: str, last: int, span: int) -> Column:
    """trailing window ``last - span < year <= last``."""
    y = F.col(year)
    return (y <= last) & (y > last - span)


def double_membership_exclude(df: DataFrame, ref: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """drop rows where *each* column is, independently, among the reference's values of its partner column
    (``!(a %in% R$a & b %in% R$b)``, not a composite key).

    The memberships are tested on the distinct value tuples of ``df``, and the tuples that meet all of them are
    anti-joined on all columns: the rows themselves are never shuffled on one, perhaps low-cardinality, column. A NULL
    is no member of anything.
    """
    cols = [c for c, _ in pairs]
    hit = df.select(*cols).distinct()
    for col, ref_col in reversed(pairs):
        keys = ref.select(F.col(ref_col).alias(col)).where(F.col(col).isNotNull()).distinct()
        hit = hit.join(keys, on=col, how="left_semi")
    return df.join(hit, on=cols, how="left_anti")


def leaf_paths(df: DataFrame, path: str = "path", sep: str = "-", min_sep: int = 2) -> DataFrame:
    """keep paths with at least ``min_sep`` separators that no other path extends.

    Each path's proper prefixes (at separator boundaries) are exploded and anti-joined: linear in the number of
    path segments instead of the pairwise regex scan.
    """
    p = F.col(path)
    n = F.size(F.split(p, sep))
    prefixes = (
        df.select(p.alias("__p"))
        .where(F.size(F.split(F.col("__p"), sep)) > 1)
        .select(
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size(F.split(F.col("__p"), sep)) - 1),
                    lambda k: F.array_join(F.slice(F.split(F.col("__p"), sep), 1, k), sep),
                )
            ).alias(path)
        )
        .distinct()
    )
    return df.where(n - 1 >= min_sep).join(prefixes, on=path, how="left_anti")


def any_member_keys(df: DataFrame, key: str, cond: Column) -> DataFrame:
    """F8: distinct keys having at least one row that meets ``cond`` (e.g. population 0 in any year)."""
    return df.where(cond).select(key).distinct()
