"""Spark session helpers.

Cluster settings (master, memory, checkpoint dir) belong to whoever submits the job; these helpers only
fill in what is unset so that local tests and the bench run with sane defaults.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None, app: str = "indexspark") -> SparkSession:
    """A local-mode session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    n = shuffle_partitions or (8 if cores == "*" else int(cores))
    b = b.config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.memory", "8g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; Spark applies it at start-up and it is read, never
    overridden. ``setCheckpointDir`` appends a fresh sub-folder on every call, so it is called at most once.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="indexspark-ckpt-", dir=os.environ.get("INDEXSPARK_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the session's shared folder, remembered for ``release_scratch``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch(spark).append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: the lineage is cut, columns are still pruned and
    filters pushed down, and the planner knows the size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession, keep: int = 0) -> None:
    """Delete what this session has stored after the first ``keep`` (``len`` of an earlier ``scratch_paths``); call it when
    the results built on it are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _scratch(spark)
    while len(paths) > keep:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def scratch_paths(spark: SparkSession) -> tuple[str, ...]:
    return tuple(_scratch(spark))


def _scratch(spark: SparkSession) -> list[str]:
    """The stored paths of one Spark application: another session's are never touched."""
    return _SCRATCH.setdefault(spark.sparkContext.applicationId, [])


_SCRATCH: dict[str, list[str]] = {}
