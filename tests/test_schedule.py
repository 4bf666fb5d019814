"""Goals run in waves by what they read, each into its own partition."""

import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from indexspark.plans import goals as G
from indexspark.plans.schedule import GoalJob, leaf_jobs, run_goals, schedule
from indexspark.sources import scores as SC
from indexspark.sources.layers import LayerStore, to_long


def test_waves_follow_reads():
    jobs = leaf_jobs()
    waves = schedule(jobs)
    assert len(waves) == 2 and waves[1] == ["NP"] and "FIS" in waves[0]
    assert schedule(jobs, ["NP"]) == [["FIS"], ["NP"]]
    job = lambda g, *reads: GoalJob(g, None, reads=reads)
    assert schedule({"a": job("a", "b", "c"), "b": job("b", "c"), "c": job("c"), "d": job("d")}) == [["c", "d"], ["b"], ["a"]]
    with pytest.raises(ValueError, match="circle"):
        schedule({"a": job("a", "b"), "b": job("b", "a")})
    with pytest.raises(ValueError, match="no job"):
        schedule({"a": job("a", "z")})


def test_run_goals_side_by_side(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.25)], "rgn_id int, v double")
    store = LayerStore(to_long(rows, "x", id_num="rgn_id", val_num="v").unionByName(to_long(rows.limit(1), "y", id_num="rgn_id", val_num="v")))
    met = threading.Barrier(2, timeout=60)  # both goals of the first wave are under way at once

    def leaf(goal, layer):
        def run(layers, scores, params):
            assert scores.count() == 0
            met.wait()
            d = layers.narrow(layer, id_num="region_id", val_num="score").withColumn("score", F.col("score") * params.get("times", 1))
            return G.GoalResult(G.scores_frame(d, goal, "status"), None)

        return run

    def total(layers, scores, params):
        assert {r.goal for r in scores.select("goal").distinct().collect()} == {"A", "B"}
        return G.GoalResult(G.scores_frame(scores.groupBy("region_id").agg(F.sum("score").alias("score")), "U", "status"), None)

    jobs = {"A": GoalJob("A", leaf("A", "x"), ("x",)), "B": GoalJob("B", leaf("B", "y"), ("y",)), "U": GoalJob("U", total, reads=("A", "B"))}
    path = tempfile.mkdtemp(prefix="indexspark-schedule-") + "/scores"
    for _ in range(2):
        out = run_goals(store, path, "s", {"A": {"times": 2}}, jobs=jobs)
    assert sorted((r.goal, r.region_id, r.score) for r in out.collect()) == [("A", 1, 1.0), ("A", 2, 0.5), ("B", 1, 0.5), ("U", 1, 1.5), ("U", 2, 0.5)]
    assert sorted(n for n in os.listdir(f"{path}/scenario=s") if n.startswith("goal=")) == ["goal=A", "goal=B", "goal=U"]
    assert SC.scenarios(spark, path) == ["s"]
    with pytest.raises(ValueError, match="without rows"):
        run_goals(store, path, "s", jobs=jobs | {"C": GoalJob("C", leaf("C", "z"), ("z",))})
