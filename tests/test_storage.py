"""Ingest without driver files, snapshots that follow their inputs, stored scenarios and reports."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from indexspark.sources import scores as SC
from indexspark.sources.catalog import catalog_for_dir
from indexspark.sources.layers import LayerStore, catalog_frame, discover_headers, fingerprint, ingest_catalog

ROWS = "region_id int, goal string, dimension string, score double"


def _write(d, name, data):
    os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
    with open(os.path.join(d, name), "wb") as fh:
        fh.write(data)


@pytest.fixture()
def layers():
    d = tempfile.mkdtemp(prefix="indexspark-layers-")
    _write(d, "cr.csv", b'"Rgn_ID","Score"\r1,0.5\r2,NA\r3,0.25')
    _write(d, "bom.csv", b"\xef\xbb\xbfrgn_id,score\r\n7,1\r\n")
    _write(d, "a b+c.csv", b"rgn_id,score\n9,2\n\n")
    _write(d, "parts.csv/part-00000-x.csv", b"rgn_id,score\n4,4\n")
    _write(d, "parts.csv/part-00001-x.csv", b"rgn_id,score\n5,5\n6,6\n")
    _write(d, "parts.csv/_SUCCESS", b"")
    return d


def test_headers_are_found_by_a_job(spark, layers):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")  # files are split: only their first part has a header
    try:
        found = discover_headers(spark, f"{layers}/*.csv")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {"cr.csv": (("rgn_id", "score"), 3), "bom.csv": (("rgn_id", "score"), 1), "a b+c.csv": (("rgn_id", "score"), 1), "parts.csv": (("rgn_id", "score"), 3)}
    cat = catalog_for_dir(spark, f"file://{layers}")
    assert sorted(r.layer for r in cat.collect()) == ["a b+c", "bom", "cr", "parts"]
    out = ingest_catalog(spark, cat, f"file://{layers}").df
    got = sorted((r.layer, r.id_num, r.val_num) for r in out.collect())
    assert got == [("a b+c", 9, 2.0), ("bom", 7, 1.0), ("cr", 1, 0.5), ("cr", 2, None), ("cr", 3, 0.25), ("parts", 4, 4.0), ("parts", 5, 5.0), ("parts", 6, 6.0)]


def test_catalog_faults_stop_the_ingest(spark, layers):
    cat = lambda **e: catalog_frame(spark, [dict(dict(layer="x", fld_id_num="rgn_id", fld_val_num="score"), **e)])
    _write(layers, "bare.csv", b"rgn_id,score\n")
    _write(layers, "empty.csv", b"")
    for entry, message in ((dict(filename="gone.csv"), "not found"), (dict(filename="bare.csv"), "without rows"), (dict(filename="empty.csv"), "without rows"), (dict(filename="cr.csv", fld_year="when"), "no column")):
        with pytest.raises(ValueError, match=message):
            ingest_catalog(spark, cat(**entry), layers)
    assert ingest_catalog(spark, cat(filename="bare.csv"), layers, allow_empty=True).df.count() == 0


def test_snapshot_follows_its_inputs(spark, layers):
    path, built = tempfile.mkdtemp(prefix="indexspark-snap-") + "/snap", []
    cat = catalog_for_dir(spark, layers)

    def take(catalog=cat):
        return LayerStore.snapshot(spark, path, lambda: built.append(1) or ingest_catalog(spark, catalog, layers), [layers], catalog)

    assert take().df.count() == take().df.count() == 8 and len(built) == 1
    _write(layers, "bom.csv", b"rgn_id,score\n7,1\n8,1\n")
    assert take().df.count() == 9 and len(built) == 2
    renamed = cat.withColumn("layer", F.concat(F.lit("l_"), "layer"))
    assert take(renamed).df.where("layer like 'l_%'").count() == 9 and len(built) == 3
    version = f"{path}/version-{fingerprint(spark, [layers], renamed)}"
    assert [n for n in os.listdir(path) if n.startswith("version-")] == [os.path.basename(version)]
    os.remove(f"{version}/_SUCCESS")  # as a copy that was cut off
    for n in os.listdir(version):
        if n.startswith("layer=l_cr"):
            for f in os.listdir(f"{version}/{n}"):
                os.remove(f"{version}/{n}/{f}")
    assert take(renamed).df.count() == 9 and len(built) == 4


def _scores(spark, *rows):
    return spark.createDataFrame(rows, ROWS)


def test_a_rerun_rewrites_only_its_goals(spark):
    path = tempfile.mkdtemp(prefix="indexspark-scores-") + "/scores"
    assert SC.scenarios(spark, path) == [] and SC.read_scores(spark, path).count() == 0
    SC.write_scores(_scores(spark, (1, "A", "status", 1.0), (2, "A", "status", None), (1, "B", "status", 3.0)), path, "x y=1")
    SC.write_scores(_scores(spark, (1, "A", "status", 9.0), (1, "B", "status", 8.0)), path, "other")
    files = lambda goal: sorted(os.listdir(f"{path}/scenario=x y%3D1/goal={goal}"))
    a, b = files("A"), files("B")
    SC.write_scores(_scores(spark, (1, "A", "trend", 5.0)), path, "x y=1", ["A"])
    assert files("B") == b and files("A") != a
    assert [tuple(r) for r in SC.read_scores(spark, path, "x y=1").orderBy("goal").collect()] == [("x y=1", "A", "trend", 1, 5.0), ("x y=1", "B", "status", 1, 3.0)]
    SC.write_scores(_scores(spark).limit(0), path, "x y=1", ["A"])  # the goal ran and came out empty
    assert [r.goal for r in SC.read_scores(spark, path, "x y=1").collect()] == ["B"]
    with pytest.raises(Exception, match="not of this run"):
        SC.write_scores(_scores(spark, (1, "C", "trend", 5.0)), path, "other", ["A"])
    assert SC.scenarios(spark, path) == ["other", "x y=1"]
    keys = spark.createDataFrame([("B", "status", 1), ("B", "status", 1), ("A", "status", 4)], "goal string, dimension string, region_id int")
    SC.patch_scores(spark, path, "x y=1", "other", keys)
    assert {(r.goal, r.score) for r in SC.read_scores(spark, path, "x y=1").collect()} == {("B", 8.0)}
    plan = SC.read_scores(spark, path, "other", ["A"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "goal" in plan
    assert [tuple(r) for r in SC.compare_scenarios(spark, path, "x y=1", "other").orderBy("goal").collect()] == [("A", "status", 1, None, 9.0, None), ("B", "status", 1, 8.0, 8.0, 0.0)]


def test_reports_are_the_same_after_a_second_run(spark):
    path = tempfile.mkdtemp(prefix="indexspark-reports-")
    one, two = spark.range(3), spark.range(2).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError, match="no committed run"):
        SC.read_report(spark, path, "one", "a")
    for _ in range(2):
        SC.write_reports(spark, {"one": one, "two": two}, path, "a")
    SC.write_reports(spark, {"one": one.limit(0)}, path, "b")
    assert SC.read_report(spark, path, "one", "a").count() == 3 and SC.read_report(spark, path, "two", "a").count() == 2
    assert SC.read_report(spark, path, "one", "b").count() == 0
    SC.write_reports(spark, {"one": one}, path, "a")  # a run without the other table removes it
    with pytest.raises(ValueError, match="no committed run"):
        SC.read_report(spark, path, "two", "a")
    assert not os.path.exists(f"{path}/two/scenario=a")
