"""Goals run in the order of what they read (2.12): a registry of goal jobs, a schedule in waves, and a run that writes
each goal's scores as its own partition of a stored score table.

A job declares the layers and the goals whose scores it reads. Goals of one wave depend on no other of it and run side by
side as Spark jobs of their own; a later wave reads the stored scores of the earlier ones, so nothing is computed twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources import scores as SC
from ..sources.layers import LayerStore
from . import goals as G
from . import metadata as M
from .scenario import LEAF_JOBS, LeafJob, empty_scores


@dataclass(frozen=True)
class GoalJob:
    """``run(layers, scores, params)`` gives a GoalResult; ``scores`` holds the goals of ``reads`` and no others."""

    goal: str
    run: LeafJob
    layers: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()


def leaf_jobs() -> dict[str, GoalJob]:
    """The leaf goals of the scenario; natural products read the scores of fisheries."""
    reads = {"NP": ("FIS",)}
    return {g: GoalJob(g, run, tuple(M.GOAL_LAYERS.get(g, ())), reads.get(g, ())) for g, run in LEAF_JOBS.items()}


def schedule(jobs: Mapping[str, GoalJob], goals: Iterable[str] | None = None) -> list[list[str]]:
    """Waves of goals: the wanted ones (default: all) and all that they read, each after what it reads.

    A goal that is not registered and goals that read each other in a circle stop it.
    """
    wanted, todo = set(), list(jobs if goals is None else goals)
    while todo:
        g = todo.pop()
        if g not in jobs:
            raise ValueError(f"no job for goal {g}")
        if g not in wanted:
            wanted.add(g)
            todo += jobs[g].reads
    waves: list[list[str]] = []
    while wanted:
        ready = sorted(g for g in wanted if not wanted.intersection(jobs[g].reads))
        if not ready:
            raise ValueError(f"goals read each other in a circle: {sorted(wanted)}")
        waves.append(ready)
        wanted -= set(ready)
    return waves


def run_goals(layers: LayerStore, path: str, scenario: str, params: Mapping[str, Mapping] | None = None,
              goals: Iterable[str] | None = None, jobs: Mapping[str, GoalJob] | None = None, side_by_side: int = 4) -> DataFrame:
    """Run the goals in waves, each written to the score table at ``path``; returns the scenario's stored scores of them.

    A goal whose layers have no row in the store is refused before anything runs. A run that fails leaves the goals that
    were done; running it again rewrites the same partitions.
    """
    spark = layers.df.sparkSession
    jobs, params = jobs or leaf_jobs(), params or {}
    waves = schedule(jobs, goals)
    all_goals = [g for wave in waves for g in wave]
    needed = sorted({lyr for g in all_goals for lyr in jobs[g].layers})
    present = {r[0] for r in layers.select_many(needed).select("layer").distinct().collect()}  # layer names
    if set(needed) - present:
        raise ValueError(f"layers without rows: {sorted(set(needed) - present)}")

    def one(goal: str) -> None:
        job = jobs[goal]
        scores = SC.read_scores(spark, path, scenario, job.reads).drop("scenario") if job.reads else empty_scores(spark)
        result: G.GoalResult = job.run(layers, scores, params.get(goal, {}))
        SC.write_goal(result.scores, path, scenario, goal)

    for wave in waves:
        with ThreadPoolExecutor(max_workers=max(1, min(side_by_side, len(wave)))) as pool:
            list(pool.map(one, wave))  # raises the first failure
    return SC.read_scores(spark, path, scenario, all_goals)
