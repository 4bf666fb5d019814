"""Embedding near-dedup by sorted projection passes.

Vectors are compared within their label only. Equal vectors are one node from here on, with a count. A pass hashes each
node by the signs of BITS random projections, concatenated to one number, orders the nodes by (label, hash) and compares
each with the WINDOW nodes after it; cosines are taken in double precision and pairs of at least LEAST are kept. The order
is a range partitioning and a sort inside each partition; other projections are drawn for every pass. Pairs from all
passes are united to components. Rounds of PASSES passes go on until a round has joined no two components, two rounds at
least: a pair that one round misses with chance q is left open only if all rounds miss it, and as long as such pairs
exist in numbers some of them turn up and call for a further round.

Neighbour windows find the components; a dense group of near copies has more links than windows meet. So each component
is then compared in full: its nodes are dealt to blocks of BLOCK, and each pair of blocks, one task's small matrix, adds
to its nodes' link counts. No pair is put out there, only counts. Every link joins two nodes of one component, so no
link inside the components found is lost, and the counts hold nothing below LEAST. The cost of that step is the square of
a component's different vectors, in blocks; equal vectors cost nothing.

Defined cases: a vector that is null, empty, zero or holds null or non-finite numbers links with nothing, nor does a row
without a label; vectors of different lengths do not link; rows repeated with id and vector link with each other and
give equal rows; a null vec_id gets its component's smallest id, or null if no row there has one; an empty table gives
an empty result; only vec_id, label and the vector are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import components

LEAST = 0.98
BITS, WINDOW, PASSES = 48, 32, 4
BLOCK = 512
SEED = 42


def _rows(vectors: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles; None where it is null or holds a null."""
    flat = vectors.flatten()
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum([0 if n is None else n for n in vectors.value_lengths().to_pylist()])])
    return [numbers[a:b] if there and not holes[a:b].any() else None for a, b, there in zip(ends[:-1], ends[1:], vectors.is_valid().to_pylist(), strict=True)]


def unit(v: np.ndarray | None) -> np.ndarray | None:
    """The vector at length 1 (scaled first, so that no square overflows), or None if it can link with nothing."""
    if v is None or not len(v) or not np.isfinite(v).all() or not (most := np.abs(v).max()):
        return None
    v = v / most
    return v / np.sqrt(v @ v)


def keyed(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, key (null for a row that links with nothing; equal for equal vectors of a label), grp, v (at length 1)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, groups, units = [], [], []
            for label, raw in zip(b.column("label").to_pylist(), _rows(b.column("v")), strict=True):
                v = None if label is None else unit(raw)
                if v is not None:
                    group = f"{len(v)}:{label}"
                    keys.append(hashlib.sha256(group.encode() + b"\0" + (raw + 0.0).tobytes()).digest())  # -0.0 becomes 0.0
                    groups.append(group)
                    units.append(v.tobytes())
                else:
                    keys.append(None)
                    groups.append(None)
                    units.append(None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(groups, pa.string()), pa.array(units, pa.binary())], ["vec_id", "key", "grp", "v"])

    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(made, f"vec_id {dict(embeddings.dtypes)['vec_id']}, key binary, grp string, v binary")


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, key, grp, v, low (smallest id), n (rows): one row per different vector of a label, numbered once."""
    alike = rows.where("key is not null").groupBy("key").agg(F.any_value("grp").alias("grp"), F.any_value("v").alias("v"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    return C.materialize(alike.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def projections(seed: int, width: int, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((bits, width))


def hashes(vectors: list[bytes], passes: list[int], bits: int = BITS) -> np.ndarray:
    """The hash of each vector in each pass."""
    out = np.zeros((len(vectors), len(passes)), np.int64)
    lengths = np.array([len(v) for v in vectors])
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        x = np.frombuffer(b"".join(vectors[i] for i in at), np.float64).reshape(len(at), -1)
        for k, p in enumerate(passes):
            out[at, k] = ((x @ projections(SEED + p, x.shape[1], bits).T) > 0) @ weights
    return out


def with_hashes(nodes: DataFrame, passes: list[int]) -> DataFrame:
    """run, grp, hash, node, v: each node once for every pass."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hashes(b.column("v").to_pylist(), passes)
            for k, p in enumerate(passes):
                run = pa.array(np.full(b.num_rows, p), pa.int32())
                yield pa.RecordBatch.from_arrays([run, b.column("grp"), pa.array(h[:, k]), b.column("node"), b.column("v")], ["run", "grp", "hash", "node", "v"])

    return nodes.select("grp", "node", "v").mapInArrow(hashed, "run int, grp string, hash long, node long, v binary")


def _same(run: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of equal values."""
    edges = np.flatnonzero(run[1:] != run[:-1]) + 1
    yield from zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(run)]]).tolist(), strict=True)


def window_pairs(x: np.ndarray, window: int, least: float, fresh: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j <= i + window, of rows with cosine ``least``, where j is not among the first ``fresh`` rows."""
    for d in range(1, min(window, len(x) - 1) + 1):
        j = np.arange(max(d, fresh), len(x))
        near = np.einsum("ij,ij->i", x[j - d], x[j]) >= least
        yield j[near] - d, j[near]


def pairs(nodes: DataFrame, passes: list[int], window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(a, b), a < b, distinct: the pairs that the windows of these passes find."""
    ordered = with_hashes(nodes, passes).repartitionByRange("run", "grp", "hash", "node").sortWithinPartitions("run", "grp", "hash", "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail_nodes, tail_rows = None, np.zeros(0, np.int64), np.zeros((0, 0))  # the last rows of the batch before
        for b in batches:
            if not b.num_rows:
                continue
            named = list(zip(b.column("run").to_pylist(), b.column("grp").to_pylist(), strict=True))
            numbers = {name: k for k, name in enumerate(dict.fromkeys(named))}
            node, v = b.column("node").to_numpy(), b.column("v").to_pylist()
            found_a, found_b = [], []
            for start, end in _same(np.array([numbers[name] for name in named])):
                ids, rows = node[start:end], np.frombuffer(b"".join(v[start:end]), np.float64).reshape(end - start, -1)
                fresh = 0
                if named[start] == last:
                    fresh = len(tail_nodes)
                    ids, rows = np.concatenate([tail_nodes, ids]), np.concatenate([tail_rows, rows])
                for i, j in window_pairs(rows, window, least, fresh):
                    found_a.append(np.minimum(ids[i], ids[j]))
                    found_b.append(np.maximum(ids[i], ids[j]))
                last, tail_nodes, tail_rows = named[start], ids[-window:], rows[-window:]
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    return ordered.mapInArrow(compared, "a long, b long").distinct()


def grouped(nodes: DataFrame, window: int = WINDOW, passes: int = PASSES, least: float = LEAST) -> DataFrame:
    """(node, component) of the nodes in components of several, after rounds of passes that end when one joins nothing."""
    labels, done = None, 0
    while True:
        found = pairs(nodes, list(range(done, done + passes)), window, least)
        if labels is not None:  # only links between components found so far count
            to = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
            found = found.join(to("a"), "a", "left").join(to("b"), "b", "left")
            found = found.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct()
        new = C.materialize(found, "links")
        done += passes
        joined = not new.isEmpty()
        if joined:
            merged = components(new)
            if labels is not None:
                moved = labels.join(merged.withColumnRenamed("node", "old").withColumnRenamed("component", "next"), F.col("component") == F.col("old"), "left")
                kept = moved.select("node", F.coalesce("next", "component").alias("component"))
                merged = kept.unionAll(merged.join(labels.select("node"), "node", "left_anti"))
            labels = C.materialize(merged, "components")
        if done > passes and not joined:
            return labels if labels is not None else nodes.sparkSession.createDataFrame([], "node long, component long")


def link_counts(members: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(node, links) of ``members`` (component, node, v, n): how many rows of other nodes of its component each links with."""
    sizes = C.materialize(members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")), "component-blocks")
    # at most half of the members' number; a component's own size decides its blocks
    dealt = C.attach(members, sizes, "component", C.materialize(C.heavy_keys(members, "component"), "heavy-components"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.withColumn("own", own).withColumn("other", every)
    met = met.select("component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "v", "n")
    met = met.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two", "own")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            now = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            cuts = list(_same_keys(now))
            yield from (_counted(now.slice(start, end - start), least) for start, end in cuts[:-1])
            held = now.slice(*((cuts[-1][0], cuts[-1][1] - cuts[-1][0]) if cuts else (0, 0)))  # the last group may go on
        if held is not None and held.num_rows:
            yield _counted(held, least)

    return met.mapInArrow(counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _same_keys(t: pa.Table) -> Iterator[tuple[int, int]]:
    if not t.num_rows:
        return
    keys = np.stack([t.column(c).to_numpy() for c in ("component", "one", "two")], 1)
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    yield from zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(keys)]]).tolist(), strict=True)


def _counted(t: pa.Table, least: float) -> pa.RecordBatch:
    """Links of a pair of blocks (of one block, its own pairs): a row for each node."""
    node, n, own = (t.column(c).to_numpy() for c in ("node", "n", "own"))
    x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(len(node), -1)
    one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
    links = np.zeros(len(node), np.int64)
    a, b = np.flatnonzero(own == one), np.flatnonzero(own == two)
    for at in range(0, len(a), BLOCK):
        part = a[at : at + BLOCK]
        near = x[part] @ x[b].T >= least
        if one == two:
            near[np.arange(len(part)), np.arange(at, at + len(part))] = False
        links[part] += near @ n[b]
        if one != two:
            links[b] += n[part] @ near
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], ["node", "links"])


def report(embeddings: DataFrame, vector: str = "embedding", window: int = WINDOW, passes: int = PASSES, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = C.materialize(keyed(embeddings, vector), "vector-keys")
    nodes = nodes_of(rows)
    found = grouped(nodes, window, passes, least)
    members = C.materialize(nodes.join(found, "node"), "members")
    lowest = C.materialize(members.groupBy("component").agg(F.min("low").alias("lowest")), "component-ids")
    named = C.attach(members.select("component", "node", "key"), lowest, "component", C.materialize(C.heavy_keys(members, "component"), "heavy-ids"))
    links = C.materialize(link_counts(members.select("component", "node", "v", "n"), least, block), "link-counts")
    linked = named.join(links, "node").select("key", "links", "lowest")
    answers = C.materialize(nodes.select("key", "low", "n").join(linked, "key", "left").where("n > 1 or links is not null"), "answers")
    answers = answers.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("lowest"))
    slim = rows.select("vec_id", "key")
    out = C.attach(slim, answers, "key", C.materialize(C.heavy_keys(slim.where("key is not null"), "key"), "heavy-vectors"))
    # a node without links and copies has no answer: its row stands for itself
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
