"""Stored scores of many scenarios, and the reports of their runs.

Scores are one Parquet table partitioned by scenario and goal. A run replaces the partitions of the goals it computed and
leaves all others as they are, by Spark's dynamic partition overwrite, so goals can run at different times or side by
side, and a rerun leaves the same table. Reports (reference points, diagnostics) are one table per kind partitioned by
scenario; a run writes each once, and last of all its own row in the table of runs, which is what readers go by.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .layers import _exists, _file_system

SCORES = "region_id int, dimension string, score double, scenario string, goal string"
KEYS = ("scenario", "goal", "dimension", "region_id")
#: The partition of reports and scores without a scenario or goal name.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _partition(root: str, **names: str | None) -> str:
    """A partition's folder as Spark writes it (names are escaped as in Hive)."""
    safe = lambda v: NO_NAME if v is None or v == "" else "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or ord(c) < 32 else c for c in v)
    return "/".join([root.rstrip("/"), *(f"{k}={safe(v)}" for k, v in names.items())])


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_scores(scores: DataFrame, path: str, scenario: str, goals: Iterable[str] | None = None) -> None:
    """Replace the slices of ``scenario`` in the table at ``path`` by ``scores(region_id, goal, dimension, score)``.

    Only the partitions of goals that ``scores`` holds are rewritten. ``goals`` names all goals of the run: those that
    came out without a row lose their old rows, and a row of another goal is refused.
    """
    spark = scores.sparkSession
    out = scores.select(F.col("region_id").cast("int"), "dimension", F.col("score").cast("double"), F.lit(scenario).alias("scenario"), "goal")
    if goals is not None:
        goals = sorted(set(goals))
        known = F.coalesce(F.col("goal").isin(goals), F.lit(False))
        refused = F.raise_error(F.concat(F.lit("a score of a goal that is not of this run: "), F.coalesce("goal", F.lit("NULL"))))
        out = out.withColumn("goal", F.when(known, F.col("goal")).otherwise(refused.cast("string")))
    out = stored(out, "scenario-scores")  # the input may be this very table
    _overwrite(out, path, "scenario", "goal")
    if goals is not None:
        present = {r[0] for r in out.select("goal").distinct().collect()}  # goal codes
        fs, at = _file_system(spark, path)
        for goal in set(goals) - present:
            fs.delete(at(_partition(path, scenario=scenario, goal=goal)), True)


def write_goal(scores: DataFrame, path: str, scenario: str, goal: str) -> None:
    """Replace the slice of one goal. Its folder is the only one written, so goals can be written side by side."""
    rows = scores.where(F.col("goal") == goal).select(F.col("region_id").cast("int"), "dimension", F.col("score").cast("double"))
    rows.write.mode("overwrite").parquet(_partition(path, scenario=scenario, goal=goal))


def read_scores(spark: SparkSession, path: str, scenario: str | None = None, goals: Iterable[str] | None = None) -> DataFrame:
    """The stored scores, of one scenario or all; only the partitions asked for are read."""
    df = spark.read.schema(SCORES).parquet(path) if _exists(spark, path) else spark.createDataFrame([], SCORES)
    if scenario is not None:
        df = df.where(F.col("scenario") == scenario)
    if goals is not None:
        df = df.where(F.col("goal").isin(list(goals)))
    return df.select(*KEYS, "score")


def scenarios(spark: SparkSession, path: str) -> list[str]:
    """The names of the stored scenarios (from the folders, no data is read)."""
    if not _exists(spark, path):
        return []
    return sorted(r[0] for r in spark.read.schema(SCORES).parquet(path).select("scenario").distinct().collect())


def patch_scores(spark: SparkSession, path: str, scenario: str, other: str, keys: DataFrame) -> None:
    """In ``scenario`` replace the slices ``keys(goal, dimension, region_id)`` by those of the scenario ``other``.

    The goals in ``keys`` are read and rewritten, no other partition.
    """
    slices = stored(keys.select("goal", "dimension", F.col("region_id").cast("int").alias("region_id")).distinct(), "slices")
    goals = sorted(r[0] for r in slices.select("goal").distinct().where("goal is not null").collect())  # goal codes
    if not goals:
        return
    on = ["goal", "dimension", "region_id"]
    mine = read_scores(spark, path, scenario, goals).drop("scenario")
    theirs = read_scores(spark, path, other, goals).drop("scenario")
    patched = mine.join(slices, on, "left_anti").unionByName(theirs.join(slices, on, "left_semi"))
    write_scores(patched, path, scenario, goals)


def compare_scenarios(spark: SparkSession, path: str, one: str, two: str) -> DataFrame:
    """goal, dimension, region_id with the score in both scenarios and the difference; a missing one is NULL."""
    tagged = read_scores(spark, path).where(F.col("scenario").isin(one, two))
    of = lambda name: F.max(F.when(F.col("scenario") == name, F.col("score")))
    both = tagged.groupBy("goal", "dimension", "region_id").agg(of(one).alias("score_one"), of(two).alias("score_two"))
    return both.withColumn("difference", F.col("score_two") - F.col("score_one"))


# ---------------------------------------------------------------- reports of a run

RUNS = "_runs"


def write_reports(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, scenario: str) -> None:
    """Write a run's tables (reference points, diagnostics) under ``path/<name>/scenario=<scenario>``.

    Reset, append, commit: each table's partition of this scenario is replaced by one write, tables of an earlier run
    that this one does not have are removed, and then the run is entered in the table of runs. Running it again leaves
    the same tables. A run that is cut off keeps its old entry, and the rerun repairs its tables.
    """
    root = path.rstrip("/")
    fs, at = _file_system(spark, root)
    for name, df in tables.items():
        if "scenario" in df.columns:
            raise ValueError(f"{name} has a column scenario of its own")
        df.write.mode("overwrite").parquet(_partition(f"{root}/{name}", scenario=scenario))  # an empty table too
    before = _listed(spark, root, scenario)
    for name in before - set(tables):
        fs.delete(at(_partition(f"{root}/{name}", scenario=scenario)), True)
    entry = spark.createDataFrame([(scenario, name) for name in sorted(tables)], "scenario string, name string")
    entry.coalesce(1).write.mode("overwrite").parquet(_partition(f"{root}/{RUNS}", scenario=scenario))


def _listed(spark: SparkSession, root: str, scenario: str) -> set[str]:
    entry = _partition(f"{root}/{RUNS}", scenario=scenario)
    return {r[0] for r in spark.read.parquet(entry).select("name").collect()} if _exists(spark, f"{entry}/_SUCCESS") else set()


def read_report(spark: SparkSession, path: str, name: str, scenario: str) -> DataFrame:
    """One table of a committed run."""
    if name not in _listed(spark, path.rstrip("/"), scenario):
        raise ValueError(f"no committed run of {scenario} has a table {name}")
    return spark.read.parquet(_partition(f"{path.rstrip('/')}/{name}", scenario=scenario))
