"""The long layer store.

Every data layer, whatever its original header, becomes rows of one long schema::

    layer STRING, id_num INT, id_chr STRING, category STRING, year INT, val_num DOUBLE, val_chr STRING

stored as Parquet partitioned by ``layer`` so that selecting a layer is partition pruning, not a scan. Ingest reads
all CSV files that share a header *shape* in one scan (``_metadata.file_path`` tells the rows apart) and unions the
shapes by name, instead of one plan branch per file.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import nan_to_null
from ..session import scratch_path

LONG_COLUMNS = ("layer", "id_num", "id_chr", "category", "year", "val_num", "val_chr")
LONG_SCHEMA = "layer string, id_num int, id_chr string, category string, year int, val_num double, val_chr string"
LONG_TYPES = dict(layer="string", id_num="int", id_chr="string", category="string", year="int", val_num="double", val_chr="string")

CATALOG_SCHEMA = (
    "layer string, targets string, filename string, fld_id_num string, fld_id_chr string, fld_category string, "
    "fld_year string, fld_val_num string, fld_val_chr string, name string, description string"
)


def to_long(df: DataFrame, layer: str | Column, **fields) -> DataFrame:
    """Project a narrow layer frame onto the long schema.

    ``fields`` maps long-schema names (``id_num``, ``category``, ...) to columns or column names of ``df``;
    absent fields become typed NULLs.
    """
    out = [(F.lit(layer) if isinstance(layer, str) else layer).alias("layer")]
    for name in LONG_COLUMNS[1:]:
        src = fields.get(name)
        if src is None:
            c = F.lit(None)
        else:
            c = F.col(src) if isinstance(src, str) else src
        c = c.cast(LONG_TYPES[name])
        if name == "val_num":
            c = nan_to_null(c)
        out.append(c.alias(name))
    return df.select(*out)


class LayerStore:
    """A long layer DataFrame with the selection operators the goal models use."""

    def __init__(self, df: DataFrame):
        missing = [c for c in LONG_COLUMNS if c not in df.columns]
        if missing:
            raise ValueError(f"not a long layer frame, missing {missing}")
        self.df = df.select(*LONG_COLUMNS)
        self.pairs: list[tuple] = []  # results that two goals share, by their parameters (plans/scenario.py)

    # S3
    def select(self, layer: str) -> DataFrame:
        return self.df.where(F.col("layer") == layer)

    # S4
    def select_many(self, layers: Sequence[str]) -> DataFrame:
        return self.df.where(F.col("layer").isin(list(layers)))

    # S5
    def by_target(self, target: str, bridge: DataFrame) -> DataFrame:
        """Rows of every layer whose catalog targets include ``target``.

        The layer names come from the catalog (one row per file and target, no cap), so the selection is a static
        ``layer IN (...)`` filter: partition pruning on the stored layer store, no join.
        """
        names = bridge.where((F.col("target") == target) & F.col("layer").isNotNull()).select("layer").distinct()
        return self.select_many(sorted(r[0] for r in names.collect()))

    # S6
    def alias(self, mapping: Mapping[str, str]) -> DataFrame:
        """``SelectLayersData(layers=c(name=label))``: selected layers with ``layer`` replaced by its label."""
        m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
        return self.select_many(list(mapping)).withColumn("layer", F.element_at(m, F.col("layer")))

    def narrow(self, layer: str, **names: str) -> DataFrame:
        """One layer with its long columns renamed back to model names, e.g. ``narrow('hab_extent',
        id_num='rgn_id', category='habitat', val_num='km2')``; only the named columns are kept."""
        return self.select(layer).select(*[F.col(k).alias(v) for k, v in names.items()])

    def union(self, other: LayerStore) -> LayerStore:
        return LayerStore(self.df.unionByName(other.df))

    # S9
    def write(self, path: str, mode: str = "overwrite") -> None:
        self.df.write.mode(mode).partitionBy("layer").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> LayerStore:
        return LayerStore(spark.read.schema(LONG_SCHEMA).parquet(path))

    def materialize(self, path: str | None = None) -> LayerStore:
        """Write the store as Parquet partitioned by ``layer`` (default: a fresh folder under the session's checkpoint
        directory, which is shared storage on a cluster) and return the store read back, so that every later layer
        selection is a partition-pruned scan and the lineage to the source tables is cut."""
        spark = self.df.sparkSession
        if path is None:
            path = scratch_path(spark, "layer-store")
        self.write(path)
        return LayerStore.read(spark, path)

    @staticmethod
    def snapshot(spark: SparkSession, path: str, build, inputs: Sequence[str] = (), catalog: DataFrame | None = None,
                 keep_old: bool = False) -> LayerStore:
        """The store that ``build`` (a callable returning a LayerStore) makes of ``inputs`` and ``catalog``, kept under
        ``path`` and made anew when one of them changes.

        A version is named by the fingerprint of its inputs: the catalog's rows and the path, size and time of every
        input file. It is written beside the others under a name that no reader looks for and renamed when complete, so
        a half-written version is never read and readers of an older one are not disturbed. Older versions are deleted
        after the switch unless ``keep_old``.
        """
        root = path.rstrip("/")
        version = f"{root}/version-{fingerprint(spark, inputs, catalog)}"
        if not _exists(spark, f"{version}/_SUCCESS"):
            draft = f"{root}/draft-{uuid.uuid4().hex}"
            build().write(draft)
            fs, at = _file_system(spark, root)
            fs.delete(at(version), True)  # an unfinished copy, on stores that rename file by file
            if not fs.rename(at(draft), at(version)) and not _exists(spark, f"{version}/_SUCCESS"):
                raise OSError(f"{draft} could not become {version}")
            if not keep_old:
                for old in fs.listStatus(at(root)):
                    name = old.getPath().getName()
                    if name.startswith("version-") and not version.endswith(name):
                        fs.delete(old.getPath(), True)
        return LayerStore.read(spark, version)


def fingerprint(spark: SparkSession, inputs: Sequence[str] = (), catalog: DataFrame | None = None) -> str:
    """SHA-256 of the input files' paths, sizes and modification times and of the catalog's rows (both metadata)."""
    found = []
    for root in inputs:
        fs, at = _file_system(spark, root)
        files = fs.listFiles(at(root), True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath().toString()}\t{f.getLen()}\t{f.getModificationTime()}")
    rows = [] if catalog is None else [repr(sorted(r.asDict().items())) for r in catalog.collect()]
    return hashlib.sha256("\n".join([*sorted(found), "", *sorted(rows)]).encode()).hexdigest()


def _decoded(path: Column) -> Column:
    """A file path as it was written: Spark's file metadata has it percent-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _file_system(spark: SparkSession, path: str):
    """The store that holds ``path``, and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at(path))


# ---------------------------------------------------------------- catalog-driven CSV ingest


def read_csv_layer(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV with header, ``NA`` and empty cells as NULL, every column read as text (typed later per catalog).

    CR, LF and CRLF line ends are all accepted by the line reader; quoted numbers stay text until cast.
    """
    return (
        spark.read.option("header", True)
        .option("nullValue", "NA")
        .option("inferSchema", False)
        .option("mode", "PERMISSIVE")
        .csv(list(paths) if not isinstance(paths, str) else paths)
    )


def _layer_file(path: Column, names: Sequence[str] | None = None) -> Column:
    """The layer file a scanned file belongs to: itself, or the folder of part files that holds it.

    With ``names`` it is whichever of the two they have; without, the folder if the file is a part file.
    """
    steps = F.split(_decoded(path), "/")
    own, folder = F.element_at(steps, -1), F.element_at(steps, -2)
    return F.when(own.isin(list(names)) if names is not None else ~own.rlike("^part-"), own).otherwise(folder)


def discover_headers(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str] | None = None) -> dict[str, tuple[tuple[str, ...], int]]:
    """Header (lower case) and number of rows of every layer file among ``paths``, as one Spark job over any store.

    The files are read as lines (CR, LF and CRLF ends alike; a part of a large file that begins inside it has no first
    line), each task keeps the first line and the count of its files, so a row per file and task is shuffled and a row
    per file comes to the driver. An empty file does not appear.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        _layer_file(F.col("_metadata.file_path"), names).alias("file"),
        F.struct(_decoded(F.col("_metadata.file_path")), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        F.when(F.col("_metadata.file_block_start") == 0, F.col("_metadata.file_path")).alias("begun"),
        F.col("value"),
    )
    found = lines.where(F.trim("value") != "").groupBy("file").agg(
        F.min_by("value", "at").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("begun").alias("parts")
    )
    split = lambda line: tuple(c.strip().strip('"').lower() for c in line.lstrip("\ufeff").split(","))
    return {r["file"]: (split(r["first"]), r["n"] - r["parts"]) for r in found.collect()}


def ingest_catalog(spark: SparkSession, catalog: DataFrame, layer_dir: str, headers: Mapping[str, Sequence[str]] | None = None,
                   allow_empty: bool = False) -> LayerStore:
    """Read every catalog layer into the long store, from any store that Spark reads.

    A catalog row names a CSV file of ``layer_dir`` or a folder of part files there. Headers are found by one Spark job
    (``discover_headers``), unless ``headers`` supplies them. Files are grouped by header shape; each group is one CSV
    scan whose rows are tagged with their file and joined (broadcast: the catalog is metadata) to the catalog to get
    layer name and field mapping. Column names and the catalog's field names are matched in lower case.

    A catalog file that is missing, empty or has no rows stops the ingest (unless ``allow_empty``, for files without
    rows), and so does a field that its header lacks.
    """
    root = layer_dir.rstrip("/")
    cat_rows = catalog.collect()  # metadata: one row per layer
    names = [r["filename"] for r in cat_rows]
    gone = [n for n in names if not _exists(spark, f"{root}/{n}")]
    if gone:
        raise ValueError(f"catalog files not found in {root}: {gone}")
    known = {n: (tuple(c.lower() for c in h), None) for n, h in (headers or {}).items()}
    wanted = [n for n in names if n not in known]
    if wanted:
        known |= discover_headers(spark, [f"{root}/{n}" for n in wanted], wanted)
    empty = [n for n in names if n not in known or known[n][1] == 0]
    if empty and not allow_empty:
        raise ValueError(f"catalog files without rows: {empty}")
    shapes: dict[tuple[str, ...], list] = defaultdict(list)
    for r in cat_rows:
        if r["filename"] in known:
            header = known[r["filename"]][0]
            lacking = [r[f] for f in r.asDict() if f.startswith("fld_") and r[f] is not None and r[f].lower() not in header]
            if lacking:
                raise ValueError(f"{r['filename']} has no column {lacking}; its header is {header}")
            shapes[header].append(r)
    parts = []
    for header, rows in shapes.items():
        files = [r["filename"] for r in rows]
        raw = read_csv_layer(spark, [f"{root}/{n}" for n in files])
        raw = raw.toDF(*header) if len(raw.columns) == len(header) else raw
        raw = raw.withColumn("__file", _layer_file(F.col("_metadata.file_path"), files))
        # fields differ per catalog row even within a shape, so pick each with a CASE over the file name
        spec = spark.createDataFrame([(r["filename"], r["layer"]) for r in rows], "__file string, __layer string")
        tagged = raw.join(F.broadcast(spec), "__file")

        def pick(field: str, rows=rows) -> Column:
            expr = None
            for r in rows:
                if r[field] is not None:
                    cond = F.col("__file") == r["filename"]
                    value = F.col(f"`{r[field].lower()}`")
                    expr = F.when(cond, value) if expr is None else expr.when(cond, value)
            return expr if expr is not None else F.lit(None)

        parts.append(
            to_long(
                tagged,
                F.col("__layer"),
                id_num=F.trim(pick("fld_id_num")).try_cast("int"),
                id_chr=pick("fld_id_chr"),
                category=pick("fld_category"),
                year=F.trim(pick("fld_year")).try_cast("int"),
                val_num=F.trim(pick("fld_val_num")).try_cast("double"),
                val_chr=pick("fld_val_chr"),
            )
        )
    if not parts:
        return LayerStore(spark.createDataFrame([], LONG_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return LayerStore(out)


def layer_target_bridge(catalog: DataFrame) -> DataFrame:
    """H1: ``layer, target`` from the space-separated ``targets`` column (all of them)."""
    parts = F.split(F.trim(F.col("targets")), r"\s+")
    return catalog.select("layer", F.explode_outer(parts).alias("target")).where(
        F.col("target").isNotNull() & (F.col("target") != "")
    )


def catalog_frame(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """A catalog DataFrame from dicts (missing fields NULL)."""
    cols = [c.split()[0] for c in CATALOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], CATALOG_SCHEMA)
