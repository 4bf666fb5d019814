"""Join operators.

Plain equi joins are left to Catalyst/AQE, which picks broadcast or sort-merge from runtime sizes. Explicit
``broadcast`` is used only for tables whose size is bounded by construction (literal lookup tables, metadata).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored


def lookup_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal lookup table, broadcast (its size is fixed by the code that declares it)."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def full_join_chain(frames: Sequence[DataFrame], on: Sequence[str] | str, unique: bool = False) -> DataFrame:
    """Full outer join of all frames on the key columns; NULL keys match NULL keys.

    With ``unique`` (each frame has one row per key, as aggregated layers have) the frames are tagged, united and
    grouped once: one shuffle whatever their number, and a key's rows meet in a bounded aggregate. A frame that repeats
    a key is refused then. Else the joins are chained, which keeps repeated keys.
    """
    keys = [on] if isinstance(on, str) else list(on)
    rest = [c for f in frames for c in f.columns if c not in keys]
    if len(set(rest)) < len(rest):
        raise ValueError(f"columns beside the keys must have different names: {sorted(rest)}")
    if not unique:
        return reduce(lambda a, b: join_null_safe(a, b, keys, how="full"), frames)
    own = lambda f: [F.col(f"`{c}`") for c in f.columns if c not in keys]
    tagged = [f.select(*keys, F.struct(F.lit(True).alias("__in"), *own(f)).alias(f"__{i}")) for i, f in enumerate(frames)]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    found = [F.max(f"__{i}").alias(f"__{i}") for i in range(len(frames))]
    twice = reduce(lambda a, b: a | b, [F.count(f"__{i}") > 1 for i in range(len(frames))])
    met = one.groupBy(*keys).agg(*found, twice.alias("__twice"))
    met = met.where(F.when(F.col("__twice"), F.raise_error(F.lit("a frame of the chain repeats a key")).cast("boolean")).otherwise(True))
    return met.select(*keys, *[F.col(f"__{i}").getField(c).alias(c) for i, f in enumerate(frames) for c in f.columns if c not in keys])


def full_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """``merge(a, b, all=TRUE)``: natural full outer join on the common columns, NULL keys match NULL keys."""
    common = [c for c in a.columns if c in b.columns]
    return join_null_safe(a, b, common, how="full")


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join where NULL keys match NULL keys (dplyr/merge semantics), output keys coalesced."""
    la = a.alias("_l")
    rb = b.alias("_r")
    cond = reduce(lambda x, y: x & y, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    j = la.join(rb, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return j
    out = []
    for k in keys:
        if how in ("full", "outer", "full_outer", "fullouter"):
            out.append(F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k))
        elif how in ("right", "right_outer", "rightouter"):
            out.append(F.col(f"_r.{k}").alias(k))
        else:
            out.append(F.col(f"_l.{k}").alias(k))
    out += [F.col(f"_l.{c}") for c in a.columns if c not in keys]
    out += [F.col(f"_r.{c}") for c in b.columns if c not in keys]
    return j.select(*out)


def semi_join(a: DataFrame, keys_df: DataFrame, on) -> DataFrame:
    """Rows of ``a`` whose key exists in ``keys_df``."""
    return a.join(keys_df, on=on, how="left_semi")


def anti_join(a: DataFrame, keys_df: DataFrame, on) -> DataFrame:
    """Rows of ``a`` whose key does not exist in ``keys_df``."""
    return a.join(keys_df, on=on, how="left_anti")


def unmatched_keys(a: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` missing from ``lookup`` (the violations table of a referential check)."""
    return a.select(*keys).distinct().join(lookup.select(*keys).distinct(), on=list(keys), how="left_anti")


def assert_no_rows(df: DataFrame, message: str) -> None:
    """Fail fast on a violations table (one small action; the table holds violations only)."""
    bad = df.limit(20).collect()
    if bad:
        raise ValueError(f"{message}: {[tuple(r) for r in bad]}")


def self_agg_join(df: DataFrame, keys: Sequence[str], *aggs, materialize: bool = False) -> DataFrame:
    """Join a group aggregate back onto its own rows (equi join: AQE may broadcast the small side).

    ``df`` is read twice; with ``materialize`` it is stored first (for a small derived aggregate whose two
    copies Catalyst would otherwise plan differently, defeating exchange reuse).
    """
    if materialize:
        df = stored(df, "self-join")
    return df.join(df.groupBy(*keys).agg(*aggs), on=list(keys), how="left")


def once(df: DataFrame) -> DataFrame:
    """Materialise a small derived frame that a plan reads more than once.

    Filters inferred from each use make the copies differ, so Spark would re-plan (re-scan and re-shuffle) the source
    per use instead of reusing one exchange; stored as Parquet it is computed once, with its sizes known to the planner.
    """
    return stored(df, "once")
