"""Readers for a scenario's configuration tables (goal tree, dimensions, pressure/resilience matrices and layer
categories). The wide matrices are unpivoted to long ``(goal, element, layer, ...)`` frames by Spark; nothing is
reshaped on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layers import _exists

GOALS_SCHEMA = (
    "order_color double, order_hierarchy double, order_calculate int, goal string, parent string, name string, "
    "name_flower string, description string, weight double, preindex_function string, postindex_function string"
)


def _csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("nullValue", "NA")
        .option("inferSchema", False)
    )
    return (r.schema(schema) if schema else r).csv(path)


def read_goals(spark: SparkSession, path: str) -> DataFrame:
    """The goal table: codes, parents, weights, calculation and hierarchy order, model calls (text, never evaluated)."""
    return _csv(spark, path, GOALS_SCHEMA)


def read_dimensions(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "dimension string, description string")


def read_pressures_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Wide ``goal, element, element_name, <layer>...`` with weights 1-3 or empty -> long rows with a weight."""
    raw = _csv(spark, path)
    keys = [c for c in ("goal", "element", "element_name") if c in raw.columns]
    layers = [c for c in raw.columns if c not in keys]
    long = raw.select(*keys, *[F.trim(F.col(c)).try_cast("double").alias(c) for c in layers]).unpivot(keys, layers, "layer", "weight")
    return long.where(F.col("weight").isNotNull())


def read_resilience_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Wide ``goal, element, <layer>...`` with ``x`` marks -> long ``(goal, element, layer)`` rows."""
    raw = _csv(spark, path)
    keys = [c for c in ("goal", "element") if c in raw.columns]
    layers = [c for c in raw.columns if c not in keys]
    long = raw.select(*keys, *[F.trim(F.col(c)).alias(c) for c in layers]).unpivot(keys, layers, "layer", "mark")
    return long.where(F.lower(F.col("mark")) == "x").drop("mark")


def read_pressure_categories(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "layer string, category string, subcategory string")


def read_resilience_categories(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "layer string, category string, category_type string, subcategory string, weight double")


def read_conf(spark: SparkSession, conf_dir: str) -> dict[str, DataFrame]:
    """All configuration tables present in ``conf_dir``."""
    readers = {
        "goals": ("goals.csv", read_goals),
        "dimensions": ("dimensions.csv", read_dimensions),
        "pressures_matrix": ("pressures_matrix.csv", read_pressures_matrix),
        "resilience_matrix": ("resilience_matrix.csv", read_resilience_matrix),
        "pressure_categories": ("pressure_categories.csv", read_pressure_categories),
        "resilience_categories": ("resilience_categories.csv", read_resilience_categories),
    }
    root = conf_dir.rstrip("/")
    return {k: fn(spark, f"{root}/{f}") for k, (f, fn) in readers.items() if _exists(spark, f"{root}/{f}")}
