"""Exact quantiles of hot groups, trees of any depth, full joins in one shuffle, columns found in the data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexspark.operators import joins as J
from indexspark.operators import quantiles as Q
from indexspark.operators import reshape as R
from indexspark.plans import hierarchy as H
from indexspark.session import release_scratch, scratch_paths, stored


def test_group_quantiles_match_type_7(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 20)
    monkeypatch.setattr(Q, "BINS", 8)
    rng = np.random.default_rng(4)
    groups = {"hot": rng.normal(size=3000), "ties": np.repeat([1.0, 2.0], [900, 1]), "skew": np.exp(rng.normal(size=500) * 9), "one": [5.0], None: [1.0, 4.0], "wide": [-1.7e308, 1.7e308, 0.0] * 9}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    out = {r.g: [r[f"q{i}"] for i in range(len(probs))] for r in Q.group_quantiles(df, ["g"], "v", probs, [f"q{i}" for i in range(len(probs))]).collect()}
    assert out["none"] == [None] * len(probs)
    for g, xs in groups.items():
        assert np.allclose(out[g], np.quantile(np.array(xs), probs), rtol=1e-12, atol=1e-12), g
    whole = Q.group_quantiles(df.where("g = 'hot'"), [], "v", [0.9], ["q"]).collect()
    assert [r.q for r in whole] == [pytest.approx(float(np.quantile(groups["hot"], 0.9)))]
    assert Q.group_quantiles(df.limit(0), ["g"], "v", [0.5], ["q"]).count() == 0


GOALS = "goal string, parent string, weight double"


def test_tree_of_four_levels(spark):
    goals = [("A", None, 1.0), ("B", None, 3.0), ("A1", "A", 2.0), ("A2", "A", 6.0), ("A21", "A2", 1.0), ("A211", "A21", 0.0), ("A212", "A21", 0.0), ("A3", "A", 100.0)]
    g = spark.createDataFrame(goals, GOALS)
    paths = {r.goal: (r.path, r.depth) for r in H.tree_paths(g).collect()}
    assert paths["A211"] == ("A-A2-A21-A211", 3) and paths["B"] == ("B", 0) and len(paths) == len(goals)
    layers = [("A", "own"), ("A1", "x"), ("A1", "y"), ("A211", "z"), ("A212", "z"), ("A212", "w"), ("A212", "w"), ("B", "b")]
    w = {r.path: r.layer_weight for r in H.tree_weights(g, spark.createDataFrame(layers, "goal string, layer string")).collect()}
    left = 1 - 1 / 6  # of A's six leaves one is its own; A3 has none and takes no weight
    want = {"A-own": 1 / 6, "A-A1-x": left / 4 / 2, "A-A1-y": left / 4 / 2, "A-A2-A21-A211-z": left * 3 / 4 / 2, "A-A2-A21-A212-z": left * 3 / 4 / 4, "A-A2-A21-A212-w": left * 3 / 4 / 4, "B-b": 3.0}
    assert set(w) == set(want) and all(math.isclose(w[k], want[k]) for k in want)


def test_cycles_and_orphans_stop_a_tree(spark):
    for bad in ([("A", None, 1.0), ("B", "C", 1.0), ("C", "B", 1.0)], [("A", None, 1.0), ("B", "gone", 1.0)], [("A", None, 1.0), ("A", None, 1.0)], [("A", "A", 1.0)]):
        with pytest.raises(ValueError):
            H.tree_paths(spark.createDataFrame(bad, GOALS))
    assert H.tree_paths(spark.createDataFrame([], GOALS)).count() == 0


def test_five_layers_join_in_one_shuffle(spark):
    frames = []
    for i in range(5):
        f = spark.createDataFrame([(k, None if k == 3 else 2000 + i % 2, float(10 * i + k)) for k in range(i, 6)], f"rgn_id int, year int, v{i} double")
        frames.append(stored(f, "layer"))
    out = J.full_join_chain(frames, ["rgn_id", "year"], unique=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    chain = J.full_join_chain(frames, ["rgn_id", "year"])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, chain.select(out.columns).collect()), key=key)
    assert len([r for r in out.collect() if r.rgn_id == 3]) == 1  # NULL years meet
    with pytest.raises(Exception, match="repeats a key"):
        J.full_join_chain([frames[0].unionAll(frames[0]), frames[1]], ["rgn_id", "year"], unique=True).collect()
    with pytest.raises(ValueError):
        J.full_join_chain([frames[0], frames[0]], ["rgn_id", "year"])


def test_pivot_finds_its_columns(spark, monkeypatch):
    df = spark.createDataFrame([("a", "2031", 1.0), ("a", "x.y z", 2.0), ("b", "2031", 3.0), ("b", "2031", 4.0), ("c", None, 9.0)], "k string, c string, v double")
    wide = R.pivot(df, ["k"], "c", None, "v", agg="sum")
    assert wide.columns == ["k", "2031", "x.y z"]
    assert sorted((r[0], r[1] or 0.0, r[2] or 0.0) for r in wide.collect()) == [("a", 1.0, 2.0), ("b", 7.0, 0.0), ("c", 0.0, 0.0)]
    as_map = R.pivot_map(df.groupBy("k", "c").agg(F.sum("v").alias("v")), ["k"], "c", "v")
    assert {r.k: r["values"] for r in as_map.collect()} == {"a": {"2031": 1.0, "x.y z": 2.0}, "b": {"2031": 7.0}}
    assert R.pivot(df.limit(0), ["k"], "c", None, "v").columns == ["k"]
    monkeypatch.setattr(R, "MOST_COLUMNS", 1)
    with pytest.raises(ValueError, match="pivot_map"):
        R.pivot(df, ["k"], "c", None, "v")


def test_scratch_is_released(spark):
    before = scratch_paths(spark)
    df = stored(spark.range(3), "kept-for-a-while")
    assert df.count() == 3 and len(scratch_paths(spark)) == len(before) + 1
    release_scratch(spark, len(before))
    assert scratch_paths(spark) == before
    with pytest.raises(Exception):
        stored(spark.range(1), "x") and df.count()
