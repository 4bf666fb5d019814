"""SimHash near-dedup with the pigeonring filter.

Fingerprint: bit b is 1 if it is set in more than half of the 64-bit hashes of a text's word shingles. Texts with one
fingerprint are one node from here on. A fingerprint is a ring of m segments. If two fingerprints differ in k bits or
fewer, then from some segment on, going round the ring, the first l segments together differ in at most l * k / m bits
for every l. The segments whose budget is below one bit must be equal, which gives one join key per start (20 bits for
m = 16, k = 3); the longer chains prune what meets under a key before the full Hamming distance is taken. A pair is
put out once, under its first valid start. Linked nodes get the smallest fingerprint of their component by repeated
minimum and shortcut steps, each written to the shared folder, and then the smallest doc_id of the component's rows.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a null doc_id gets its
component's smallest id, or null if no row of the component has one; rows repeated with id and text give equal rows, and
an id with several texts is judged text by text; an empty table gives an empty result; only doc_id and text are read,
whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 3
MOST_BITS = 3
SEGMENTS = 16
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_AT_ONCE = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number. Hashes are added up in bounded pieces."""
    w = text.translate(_LOWER).split()  # bytes.split() splits at x20 and x09-x0D
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _AT_ONCE):
        h = [digest(b" ".join(w[i : i + shingle]), SEED) for i in range(at, min(n, at + _AT_ONCE))]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp of every row."""
    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array([0 if t is None else fingerprint(t, shingle) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return docs.select("doc_id", C.text_hash().alias("text_hash"), fp(F.col("text").cast("string")).alias("fp"))


def _turned(x: Column, by: Column) -> Column:
    """x rotated left by ``by`` bits (0 to 63)."""
    return F.when(by == 0, x).otherwise(F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(64) - by)))


def _chain(x: Column, k: int, m: int) -> Column:
    """Whether the differing bits x, seen from their first segment on, stay within every budget."""
    width = 64 // m
    tests = []
    for differ in range(1, k):  # the longest chain with each budget has the strictest test
        longest = max(l for l in range(1, m + 1) if l * k // m == differ)
        tests.append(F.bit_count(F.call_function("shiftrightunsigned", x, F.lit(64 - width * longest))) <= differ)
    test = F.bit_count(x) <= k
    for t in reversed(tests):
        test = t & test
    return test


def links(nodes: DataFrame, k: int = MOST_BITS, m: int = SEGMENTS) -> DataFrame:
    """(a, b) for all pairs of ``nodes`` (node, fp; distinct fps) that differ in at most k bits, each once."""
    width = 64 // m
    equal = max([l for l in range(1, m + 1) if l * k // m == 0], default=0)
    if not equal:
        raise ValueError("more differing bits than segments")
    starts = F.explode(F.array(*[F.struct(F.lit(width * i).alias("turn"), _turned(F.col("fp"), F.lit(width * i)).alias("x")) for i in range(m)])).alias("s")
    turned = nodes.select("node", starts).select("node", "s.x", "s.turn")
    key = F.call_function("shiftrightunsigned", F.col("x"), F.lit(64 - width * equal)).bitwiseOR(F.call_function("shiftleft", F.col("turn").cast("long"), F.lit(56)))
    turned = turned.select("node", "x", "turn", key.alias("key")) if width * equal <= 56 else turned.withColumn("key", F.struct("turn", "x"))
    a, b = turned.alias("a"), turned.select("node", "x", "key").alias("b")
    d = F.col("a.x").bitwiseXOR(F.col("b.x"))
    # turned back by so many segments, no earlier start is valid: the pair is not put out twice
    earlier = F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("a.turn") / width).cast("int")),
        lambda back: (F.col("a.turn") > 0) & _starts(_turned(d, F.lit(64) - back * width), k, m, equal),
    )
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & _chain(d, k, m) & ~earlier)
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _starts(x: Column, k: int, m: int, equal: int) -> Column:
    return (F.call_function("shiftrightunsigned", x, F.lit(64 - 64 // m * equal)) == 0) & _chain(x, k, m)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b): the smallest node that can be reached."""
    both = C.materialize(edges.unionAll(edges.select("b", "a")).toDF("a", "b"), "edges")
    labels = C.materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "low").alias("low"))
        jump = labels.select(F.col("node").alias("of"), F.col("component").alias("next"))
        new = C.materialize(lower.join(jump, F.col("low") == F.col("of")).select("node", "old", F.col("next").alias("component")), "labels")
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def clusters(docs: DataFrame, shingle: int = SHINGLE, k: int = MOST_BITS, m: int = SEGMENTS) -> DataFrame:
    """doc_id, text_hash, fp, component (its smallest fp; null for a row alone), component_id of every row."""
    prints = C.materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = C.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), k, m))
    lowest = found.join(nodes, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("low").alias("lowest"))
    lowest = C.materialize(lowest, "component-ids")
    named = C.attach(found, lowest, "component", C.materialize(C.heavy_keys(found, "component"), "heavy-components"))
    shared = nodes.join(named, F.col("fp") == F.col("node"), "left").where("node is not null or n > 1")
    shared = shared.select("fp", F.coalesce("component", "fp").alias("component"), F.least("low", "lowest").alias("component_id"))
    shared = C.materialize(shared, "shared-fingerprints")
    out = C.attach(prints, shared, "fp", C.materialize(C.heavy_keys(prints, "fp"), "heavy-fingerprints"))
    return out.select("doc_id", "text_hash", "fp", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return clusters(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, k: int = MOST_BITS) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id (of components without any id, all).

    A document is an id with a text: of several texts with the smallest id, that with the smallest hash stays.
    """
    found = clusters(docs, shingle, k).where("component is not null and component_id is not null")
    found = C.materialize(found.select("doc_id", "text_hash", "component", "component_id").distinct(), "near-copies")
    first = found.where("doc_id = component_id").groupBy("component").agg(F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("n"))
    several = found.where("doc_id = component_id").join(first.where("n > 1"), "component").where("text_hash <> first")
    gone = found.where("not (doc_id <=> component_id)").select("doc_id", "text_hash").unionAll(several.select("doc_id", "text_hash"))
    return C.keep_other_rows(docs, C.materialize(gone, "near-copies-gone"))
