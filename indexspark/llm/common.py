"""Shared helpers of the operators: tables, shared scratch space, size-checked broadcasts, heavy keys.

Nothing here depends on the machine the driver runs on: intermediate tables go to the folder that the session names in
``spark.checkpoint.dir`` and are written by Spark's own committers, so a lost executor costs only its unfinished tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast, and their largest share of a row in bytes (keys and a few numbers).
BROADCAST_ROWS = 400_000
#: Share of all rows from which a key counts as heavy; so 1/HEAVY_SHARE keys are tracked at most.
HEAVY_SHARE = 0.001

_WRITTEN: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_id() -> str:
    return uuid.uuid4().hex


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/llm-{label}-{new_id()}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and gives the planner real sizes."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the scratch tables written after the first ``keep``; call it when results built on them are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_WRITTEN) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def scratch_mark() -> int:
    """How many scratch tables exist now, for ``release``."""
    return len(_WRITTEN)


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (materialised, narrow) with a broadcast hint if it has few enough rows; else as it is, for a shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out() -> Column:
    """True for the documents on which nothing is learned: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Misra-Gries heavy keys of ``df``, verified: rows (key, n) with the exact count of each key above ``share``.

    ``freqItems`` keeps 1/share counters and reports every key above that share, and some below it. The exact counts
    of these few candidates, again over all rows, decide. At most 1/share rows come out.
    """
    found = df.select(key).freqItems([key], share).select(F.explode(F.col(f"{key}_freqItems")).alias(key))
    exact = df.select(key).join(F.broadcast(found), key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return exact.where(F.col("n") > F.lit(max(1, int(share * df.count()))))


def attach(df: DataFrame, table: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Left join of ``table`` (one row per key) to ``df``: heavy keys by broadcast, so no task gets all their rows."""
    hot = F.broadcast(materialize(table.join(F.broadcast(heavy.select(key)), key, "left_semi"), "heavy"))
    marked = df.join(F.broadcast(heavy.select(key, F.lit(True).alias("__hot"))), key, "left")
    rest = marked.where("__hot is null").drop("__hot").join(table, key, "left")
    return marked.where("__hot").drop("__hot").join(hot, key, "left").select(rest.columns).unionAll(rest)


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column (in either case) has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def same_row(docs: DataFrame, id_: str, hash_: str) -> Column:
    """Whether a row of ``docs`` is the one named by an id (null matches null) and a text's hash."""
    return docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col(hash_))


def keep_other_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` (materialised: doc_id, text_hash) names. Null ids match null ids."""
    id_, hash_ = (free_name(docs.columns, n) for n in ("__id", "__hash"))
    gone = small(gone.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)))
    return docs.join(gone, same_row(docs, id_, hash_), "left_anti")


def text_hash() -> Column:
    return F.xxhash64(text_or_empty())
