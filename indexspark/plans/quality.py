"""Data-quality reports returned beside the scores (the reference's range assertions and warnings, as DataFrames).

Each check is a filter or a small aggregate over a scores or layer frame; a check never collects data, and callers
decide whether a non-empty report should fail the job (``fail_if_any``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: valid range of each dimension
DIMENSION_RANGES = {
    "status": (0.0, 100.0), "future": (0.0, 100.0), "score": (0.0, 100.0),
    "pressures": (0.0, 100.0), "resilience": (0.0, 100.0), "trend": (-1.0, 1.0),
}


def dimension_range_violations(scores: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose score lies outside its dimension's range (NULL scores are not violations)."""
    lo = F.create_map(*[F.lit(x) for k, (a, _) in DIMENSION_RANGES.items() for x in (k, a)])
    hi = F.create_map(*[F.lit(x) for k, (_, b) in DIMENSION_RANGES.items() for x in (k, b)])
    s = scores.withColumns({"lo": F.element_at(lo, F.col("dimension")), "hi": F.element_at(hi, F.col("dimension"))})
    bad = F.col("score").isNotNull() & F.col("lo").isNotNull() & (
        (F.col("score") < F.col("lo") - tolerance) | (F.col("score") > F.col("hi") + tolerance)
    )
    return s.where(bad).select("region_id", "goal", "dimension", "score", "lo", "hi")


def unknown_dimensions(scores: DataFrame) -> DataFrame:
    """Rows whose dimension is not one of the six known dimensions."""
    return scores.where(~F.coalesce(F.col("dimension").isin(list(DIMENSION_RANGES)), F.lit(False)))


def duplicate_keys(scores: DataFrame) -> DataFrame:
    """(region, goal, dimension) keys that occur more than once."""
    return scores.groupBy("region_id", "goal", "dimension").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def coverage(scores: DataFrame) -> DataFrame:
    """Per goal and dimension: rows, non-NULL scores and regions."""
    return scores.groupBy("goal", "dimension").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("score").alias("n_scores"), F.count_distinct("region_id").alias("n_regions")
    )


def fail_if_any(report: DataFrame, message: str, limit: int = 20) -> None:
    """Raise with up to ``limit`` example rows when a report is non-empty (one small action)."""
    rows = report.limit(limit).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")


def scores_report(scores: DataFrame) -> dict[str, DataFrame]:
    return {
        "range_violations": dimension_range_violations(scores),
        "unknown_dimensions": unknown_dimensions(scores),
        "duplicate_keys": duplicate_keys(scores),
        "coverage": coverage(scores),
    }
