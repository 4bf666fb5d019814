"""Vector code compression: product codes by k-means over integers, with LAESA pivots for the nearest entry.

Each component becomes floor(256 * x). Vectors are cut into PARTS equal consecutive parts, and each part position has a
codebook of ENTRIES entries, first the parts of the vectors with the smallest ids. A few entries of each first codebook,
far from each other, are its fixed pivots: the distances from every part to them are computed once and stored. In each
round the distances from the pivots to the present entries are taken anew (64 by PIVOTS a position). By the triangle
inequality the largest difference |d(part, pivot) - d(entry, pivot)| bounds d(part, entry) from below. Entries are then
evaluated in the order of that bound, exactly and in integers, until the least bound left lies above the best distance.
Bounds are floating-point numbers lowered by a margin, so no entry that could win or tie is skipped.

A round is one pass over the stored integers: each task assigns its rows and puts out one sum and count per position and
entry, which Spark adds up. Only codebooks (ENTRIES times the vector length) reach the driver.

Defined cases: a row is dropped if its vector is null or holds a null or a number that is not finite; vectors shorter
than the longest, or a length that PARTS does not divide, are filled with zeros at their ends; an empty vector is all
zeros; integers beyond 2^26 either way are held there, so that sums stay in 64 bits; with fewer rows than ENTRIES the
codebooks are smaller; rows repeated are coded each and may give equal entries, of which the first is used; a null vec_id
is larger than any other, equal ids go by their vectors; an empty table gives an empty result; only vec_id, label and
the vector are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
SCALE = 256.0
MOST = 1 << 26
_MARGIN = 1e-9
OUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def usable(vector: Column) -> Column:
    """True for a vector without null and non-finite components."""
    fine = lambda x: F.coalesce((F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")), F.lit(False))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, filled with zeros up to ``width``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def integers(rows: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(rows * SCALE), -MOST, MOST).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` (n, d) to the few rows of ``b`` (m, d)."""
    return np.stack([np.sqrt(((a - x) ** 2).sum(1).astype(np.float64)) for x in b], axis=1)


def far_entries(entries: np.ndarray, most: int) -> np.ndarray:
    """Pivots: the first entry, then each time the entry whose distances to the pivots so far add up to the most."""
    chosen = [0]
    total = distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(most, len(entries)):
        total[chosen] = -1.0
        chosen.append(int(total.argmax()))
        total += distances(entries, entries[chosen[-1:]])[:, 0]
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``x`` the nearest entry (ties to the lower index), its squared distance; and how many were evaluated."""
    low = np.zeros((len(x), len(entries)))
    for m in range(to_pivots.shape[1]):
        np.maximum(low, np.abs(to_pivots[:, m, None] - entry_pivots[None, :, m]), out=low)
    low = np.maximum(low * (1 - _MARGIN) - _MARGIN, 0.0) ** 2
    who = np.full(len(x), len(entries))
    best = np.full(len(x), np.iinfo(np.int64).max)
    open_, evaluated = np.arange(len(x)), 0
    while len(open_):
        bounds = low[open_]
        j = bounds.argmin(1)
        go = bounds[np.arange(len(open_)), j] <= best[open_]  # an evaluated entry's bound is infinite
        open_, j = open_[go], j[go]
        d = ((x[open_] - entries[j]) ** 2).sum(1)
        better = (d < best[open_]) | ((d == best[open_]) & (j < who[open_]))
        best[open_[better]], who[open_[better]] = d[better], j[better]
        low[open_, j] = np.inf
        evaluated += len(open_)
    return who, best, evaluated


class Books:
    """The codebooks (position, entry, component) of one round with the fixed pivots' distances to them."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.entry_pivots = [distances(e, p) for e, p in zip(entries, pivots, strict=True)]

    def assign(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every row and position; x: (n, position, component)."""
        found = [nearest(x[:, p], to_pivots[:, p], self.entries[p], self.entry_pivots[p])[:2] for p in range(len(self.entries))]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _stored(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(n, parts, -1)
    return x, batch.column("to_pivots").flatten().to_numpy().reshape(n, parts, -1)


def first_books(kept: DataFrame, width: int, parts: int, entries: int, pivots: int) -> Books | None:
    """The codebooks of the smallest ids: at most ``entries`` rows come to the driver."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    if not len(rows):
        return None
    cut = integers(matrix(rows, width)).reshape(len(rows), parts, -1).transpose(1, 0, 2)
    return Books(cut, np.stack([far_entries(e, pivots) for e in cut]))


def with_pivots(kept: DataFrame, books: Books, width: int) -> DataFrame:
    """vec_id, label, x (the integers), to_pivots (their parts' distances to the pivots): written once for all rounds."""
    pivots = books.pivots

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(matrix(b.column("v"), width))
            cut = x.reshape(len(x), len(pivots), -1)
            far = np.concatenate([distances(cut[:, p], pivots[p]) for p in range(len(pivots))], axis=1)
            lists = lambda a, kind: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel(), kind), a.shape[1]).cast(pa.list_(kind))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists(x.astype(np.int32), pa.int32()), lists(far, pa.float64())], ["vec_id", "label", "x", "to_pivots"])

    kind = dict(kept.dtypes)
    made = kept.mapInArrow(measured, f"vec_id {kind['vec_id']}, label {kind['label']}, x array<int>, to_pivots array<double>")
    return C.materialize(made, "vector-parts")


def replaced(stored: DataFrame, books: Books) -> Books:
    """One round: all parts assigned, then each used entry replaced by the floored mean of its parts."""
    parts, entries, size = books.entries.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, size, entries), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x, far = _stored(b, parts)
            who = books.assign(x, far)[0]
            for p in range(parts):
                counts[p] += np.bincount(who[:, p], minlength=entries)
                for i in range(size):  # a batch's sums are below 2^53, so exact
                    sums[p, i] += np.bincount(who[:, p], x[:, p, i], entries).astype(np.int64)
        at = np.argwhere(counts > 0)
        lists = sums.transpose(0, 2, 1)[at[:, 0], at[:, 1]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[at[:, 0], at[:, 1]], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    partial = stored.mapInArrow(summed, "part int, entry int, n long, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]
    new = books.entries.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # a row an entry
        new[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return Books(new, books.pivots)


def coded(stored: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code, error of every stored row."""
    parts = len(books.entries)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, far = books.assign(*_stored(b, parts))
            codes = ["".join(f"{e:02x}" for e in row) for row in who.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(far.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    kind = dict(stored.dtypes)
    return stored.mapInArrow(assigned, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def train(embeddings: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame | None, Books | None]:
    """The stored parts and the codebooks after all rounds; None, None without any usable row."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    kept = embeddings.select("vec_id", "label", F.col(vector).alias("v")).where(usable(F.col("v")))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None, None
    width = max(1, -(-longest // parts)) * parts
    books = first_books(kept, width, parts, entries, pivots)
    stored = with_pivots(kept, books, width)
    for _ in range(rounds):
        books = replaced(stored, books)
    return stored, books


def report(embeddings: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a usable vector."""
    spark = embeddings.sparkSession
    stored, books = train(embeddings, vector, parts, entries, rounds, pivots)
    if stored is None:
        return spark.createDataFrame([], OUT)
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("of")
    codes = C.materialize(coded(stored, books).select("vec_id", "code", "error", named), "codes")
    by_label = C.materialize(codes.groupBy("of").agg(F.sum("error").alias("label_error")), "label-errors")
    if by_label.count() <= C.BROADCAST_ROWS:
        out = codes.join(F.broadcast(by_label), "of")
    else:
        out = C.attach(codes, by_label, "of", C.materialize(C.heavy_keys(codes, "of"), "heavy-labels"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
