"""Exact dedup by a heavy-hitter split: frequent texts are settled by broadcast, the others by a shuffle.

Each text is replaced by its SHA-256 once. Misra-Gries counters find the digests that hold more than a fixed share of
all rows; their exact counts verify them. For these few winners the row that stays is found by a map-side aggregate and
broadcast, so their rows are judged where they are read. All other digests have few rows each and are grouped by an
ordinary shuffle.

Defined cases: a null text is the empty text, and empty texts are equal to each other; a null doc_id is smaller than any
other; rows repeated with id and text get one answer each, all with the same values (``dedup`` keeps one of them: the
largest by its other columns); an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of every row, written once."""
    return C.materialize(docs.select("doc_id", F.sha2(C.text_or_empty(), 256).alias("text_sha256")), "digests")


def groups(marked: DataFrame, share: float = C.HEAVY_SHARE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (and ``carry``) of every row of ``digests``' result."""
    key = "text_sha256"
    of_group = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = C.materialize(C.heavy_keys(marked, key, share).select(key), "heavy-digests")
    winners = C.materialize(marked.join(F.broadcast(heavy), key, "left_semi").groupBy(key).agg(*of_group), "winners")
    met = marked.join(F.broadcast(winners), key, "left")
    rest = met.where("group_size is null").select("doc_id", key, *carry)
    several = rest.groupBy(key).agg(*of_group).where("group_size > 1")
    alone = [F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")]
    cold = rest.join(several, key, "left").select("doc_id", key, *carry, *alone)
    both = met.where("group_size is not null").select("doc_id", key, *carry, "keep_id", "group_size").unionAll(cold)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return both.select("doc_id", "keep_id", F.col("group_size").cast("long"), kept, key, *carry)


def exact_dedup(docs: DataFrame, share: float = C.HEAVY_SHARE) -> DataFrame:
    """One row per row of ``docs``: which document of its equal texts stays."""
    return groups(digests(docs), share)


def dedup(docs: DataFrame, share: float = C.HEAVY_SHARE) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as they are."""
    with_hash = docs.select("doc_id", F.sha2(C.text_or_empty(), 256).alias("text_sha256"), C.text_hash().alias("text_hash"))
    marked = C.materialize(with_hash, "digests")
    judged = groups(marked, share, ("text_hash",))
    gone = C.materialize(judged.where("not kept").select("doc_id", "text_hash"), "copies")
    left = C.keep_other_rows(docs, gone)
    again = marked.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = C.materialize(again.select("doc_id", "text_hash"), "repeated")
    if again.isEmpty():
        return left
    names = docs.columns
    id_, hash_ = (C.free_name(names, n) for n in ("__id", "__hash"))
    twice = left.join(C.small(again.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))), C.same_row(left, id_, hash_))
    one = twice.groupBy(id_, hash_).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in names])).alias("row"))
    return C.keep_other_rows(left, again).unionAll(one.select([F.col("row").getField(c).alias(c) for c in names]))
