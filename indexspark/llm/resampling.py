"""Target-distribution importance resampling: bucketed word weights held as an array, then a distributed LSD radix sort.

Words are lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters. Features are all runs of 1 to
RUNS words, joined by one space, repeats counted; a feature's bucket is the crc32 of its UTF-8 bytes modulo BUCKETS. The
bucket counts of the documents and of the target texts are taken over all rows (each task sums its own, so at most
BUCKETS numbers leave it) and give one array of gains. A document's weight is the floored mean of its features' gains;
a Gumbel number from a hash of its id is added, so that the highest scores are a sample drawn by weight.

The ranks come from a least-significant-digit radix sort over the composite key (score descending, doc_id ascending), 16
bits a pass. In each pass, blocks of rows count their digits; prefix sums over (digit, block) give each block's first
destination for each digit; a row's destination is that plus its place among the block's rows of the same digit. Passes
are stable, so after the last the destination is the final rank. Digits that are equal in all rows need no pass. Every
pass is written to the shared folder, so that destinations do not change when a task is run again.

Defined cases: a null text has no words; a document without features weighs 0; rows repeated are drawn each, in
neighbouring ranks of either order; a null doc_id counts as an empty text in the hash and ranks after all others of its
score; without target texts every t is 0; an empty table gives an empty result; only doc_id and text are read, whatever
other columns there are.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

RUNS, BUCKETS = 1, 10_000
SEED = "2024"
LEAST_WORDS, PERCENT = 20, 10
DIGIT_BITS = 16
#: Rows of a block of the sort after its first pass.
BLOCK = 1 << 18
#: Other bytes than letters, digits and those of non-ASCII characters become blanks; A-Z become a-z.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes, runs: int = RUNS) -> tuple[Counter, int]:
    """How often each feature occurs, and the number of words."""
    words = text.translate(_TO_WORDS).split()
    found = Counter(words)
    for k in range(2, runs + 1):
        found.update(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return found, len(words)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist())


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features by bucket over all rows of ``texts`` (text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for t in _texts(b):
                found, _ = features(t, runs)
                np.add.at(sums, [zlib.crc32(f) % buckets for f in found], list(found.values()))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    partial = texts.select(C.text_or_empty().alias("text")).mapInArrow(counted, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(of_documents: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, counts raised by one."""
    n, s, t = len(of_documents), int(of_documents.sum()), int(of_target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(of_documents, of_target, strict=True)], np.int64)


def gumbel(doc_id, seed: str = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    table = gain.tolist()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(table)
        for b in batches:
            words, counts, weights, scores = [], [], [], []
            for doc_id, t in zip(b.column("doc_id").to_pylist(), _texts(b), strict=True):
                found, n = features(t, runs)
                total = sum(found.values())
                weight = sum(k * table[zlib.crc32(f) % size] for f, k in found.items()) // total if total else 0
                words.append(n)
                counts.append(total)
                weights.append(weight)
                scores.append(weight + gumbel(doc_id, seed))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, counts, weights, scores))], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select("doc_id", C.text_or_empty().alias("text"))
    return rows.mapInArrow(weighed, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long, score long")


def _digits(rows: DataFrame, key: Column) -> list[Column]:
    """The digits of a 64-bit key, least significant first, without those that are equal in all rows.

    Subtracting the least key leaves few digits; a range beyond 63 bits is turned to unsigned order instead.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    wide = high - low >= 1 << 63
    x = key.bitwiseXOR(F.lit(-(1 << 63))) if wide else key - F.lit(low)
    bits = 64 if wide else (high - low).bit_length()
    return [F.call_function("shiftrightunsigned", x, F.lit(at)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int") for at in range(0, bits, DIGIT_BITS)]


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """``rows`` (block, at) put into the stable order of ``digit``: at becomes the destination, block its block."""
    counted = rows.withColumn("digit", digit)
    counts = C.materialize(counted.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n")), "digit-counts")
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    # one row a digit, 2^DIGIT_BITS at most
    before = totals.select("digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
    first = counts.withColumn("within", within).join(before, "digit").select("digit", "block", (F.col("before") + F.col("within")).alias("first"))
    place = F.row_number().over(Window.partitionBy("block", "digit").orderBy("at")) - 1
    moved = counted.withColumn("place", place).join(first, ["block", "digit"])
    to = (F.col("first") + F.col("place")).cast("long")
    keep = [c for c in rows.columns if c not in ("block", "at")]
    return C.materialize(moved.select(*keep, F.floor(to / F.lit(BLOCK)).cast("long").alias("block"), to.alias("at")), "sorted")


def radix_ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (at least doc_id, score) with place: 0 for the highest score, ties to the smaller doc_id."""
    started = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.call_function("shiftright", F.col("at"), F.lit(33)))
    now = C.materialize(started, "unsorted")
    passes = [*_digits(now, F.col("doc_id")), *([] if now.where("doc_id is null").isEmpty() else [F.col("doc_id").isNull().cast("int")])]
    passes = [F.coalesce(d, F.lit(0)) for d in passes]
    passes += _digits(now, -F.col("score"))
    for digit in passes or [F.lit(0)]:  # rows that are all alike still need dense places
        now = counting_pass(now, digit)
    return now.withColumnRenamed("at", "place").drop("block")


def report(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null where the document is not drawn."""
    gain = gains(bucket_counts(docs, runs), bucket_counts(target, runs))
    rows = C.materialize(scored(docs, gain, runs), "scored")
    able = F.col("n_words") >= least_words
    draw = percent * rows.where(able).count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = radix_ranks(rows.where(able).select(*names)).select(*names, F.when(F.col("place") < draw, F.col("place") + 1).cast("long").alias("rank"))
    return ranked.unionAll(rows.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))
