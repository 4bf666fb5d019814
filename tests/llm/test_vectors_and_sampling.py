"""Vector codes, embedding near-dedup and importance resampling against brute force, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexspark.llm import embedding_dedup, resampling, vector_codes

SF = "/root/testdata/sf0.001"
EMB = "vec_id bigint, embedding array<float>, label int, key string, grp string, v int, x string, node int, n int, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, "k", "g", 1, "x", 2, 3, "c") for i, v, label in rows], EMB)


def got(df):
    return [r.asDict() for r in df.collect()]


# --- vector codes


def codes_of(rows, parts, entries, rounds):
    """Brute force: every part against every entry, in Python integers. rows: (vec_id, vector, label), lengths equal."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = [[x[p * size : (p + 1) * size] for p in range(parts)] for _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((dist(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[near(p, c[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(held[k]) for col in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{near(p, c[p])[1]:02x}" for p in range(parts)), sum(near(p, c[p])[0] for p in range(parts)), label) for (i, _, label), c in zip(kept, cut, strict=True)]
    by = Counter()
    for _, _, e, label in out:
        by[label] += e
    return Counter((i, code, e, by[label], sha) for i, code, e, label in out)


@pytest.mark.parametrize("entries,parts,rounds", [(8, 4, 2), (64, 4, 1), (3, 2, 0)])
def test_vector_codes(spark, entries, parts, rounds):
    rng = np.random.default_rng(5)
    some = rng.normal(size=(6, 8)) * 3
    rows = [(int(i), np.float32(some[i % 6] + rng.normal(size=8) * rng.choice([0, 0.01, 0.4])).tolist(), None if i % 7 == 0 else int(i % 3)) for i in range(150)]
    rows += [(200, None, 1), (201, [None, *rows[0][1][1:]], 1), (202, [float("nan"), *rows[0][1][1:]], 1), (203, [float("inf"), *rows[0][1][1:]], 2), (None, rows[9][1], None), (5, rows[5][1], 1), (-4, [0.0] * 8, 0)]
    out = got(vector_codes.report(vectors(spark, rows), parts=parts, entries=entries, rounds=rounds))
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out) == codes_of(rows, parts, entries, rounds)


def test_pivots_prune_and_keep_ties():
    rng = np.random.default_rng(1)
    x, entries = rng.integers(-200, 200, (3000, 4)), rng.integers(-200, 200, (64, 4))
    entries[40] = entries[7]  # equal entries: the lower index wins
    x[:50] = entries[40]
    pivots = vector_codes.far_entries(entries, vector_codes.PIVOTS)
    assert len(np.unique(pivots, axis=0)) == vector_codes.PIVOTS
    who, best, evaluated = vector_codes.nearest(x, vector_codes.distances(x, pivots), entries, vector_codes.distances(entries, pivots))
    full = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (who == full.argmin(1)).all() and (best == full.min(1)).all() and (who[:50] == 7).all()
    assert evaluated < 0.25 * full.size  # a plain search evaluates all


def test_vector_codes_edges(spark):
    none = vectors(spark, [(1, None, 1), (2, [None], 2)])
    for df in (none, none.limit(0)):
        out = vector_codes.report(df)
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    one = got(vector_codes.report(vectors(spark, [(None, [], None), (None, [], None)])))  # empty vectors are zeros
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 16, 0, 0)] * 2
    uneven = got(vector_codes.report(vectors(spark, [(1, [1.0] * 3, 1), (2, [1.0] * 18, 1), (3, [1e30] * 2, 2)])))
    assert {r["vec_id"]: (r["code"][:2], r["error"]) for r in uneven} == {1: ("00", 0), 2: ("00", 0), 3: ("02", 0)}
    assert {r["code"][16:18] for r in uneven if r["vec_id"] == 2} == {"01"}


# --- embedding near-dedup


def linked(rows, least=0.98):
    """Brute force: links and components of the rows, as (vec_id, n_links, component_id, kept) counted."""
    ok = lambda v: v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok(v) and label is not None else None for _, v, label in rows]
    near = lambda a, b: a != b and rows[a][2] == rows[b][2] and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least
    to = {a: [b for b in range(len(rows)) if near(a, b)] for a in range(len(rows))}
    out, seen = Counter(), {}
    for a in range(len(rows)):
        if a not in seen:
            group, stack = {a}, [a]
            while stack:
                for b in to[stack.pop()]:
                    if b not in group:
                        group.add(b)
                        stack.append(b)
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            seen.update(dict.fromkeys(group, min(ids) if ids else None))
    for a, (i, _, _) in enumerate(rows):
        out[i, len(to[a]), seen[a], i == seen[a]] += 1
    return out


def planted(seed=3):
    """Dense groups larger than a window, chains, lone pairs and strangers, over three labels."""
    rng = np.random.default_rng(seed)
    at = lambda base, noise: np.float32(base + rng.normal(size=24) * noise).tolist()
    rows, i = [], 0
    for label in range(3):
        for size, noise in ((120, 0.03), (40, 0.08), *[(2, 0.05)] * 25, *[(1, 0)] * 120):
            base = rng.normal(size=24)
            for _ in range(size):
                rows.append((i, at(base, noise), label))
                i += 1
        a, b = np.linalg.qr(rng.normal(size=(24, 2)))[0].T
        rows += [(i + k, np.float32(a * math.cos(0.15 * k) + b * math.sin(0.15 * k)).tolist(), label) for k in range(9)]  # a chain
        i += 9
    return [rows[k] for k in rng.permutation(len(rows))]


def test_embedding_dedup(spark):
    rows = planted()
    rows += [(5000, rows[0][1], rows[0][2]), (5001, rows[0][1], None), (None, rows[0][1], rows[0][2]), (5000, rows[0][1], rows[0][2])]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 24, 1), (6003, [float("nan")] * 24, 1), (6004, [None] * 24, 1), (6005, [1.0] * 23, 1), (6006, [2.0] * 23, 1), (None, None, None), (6007, [-0.0, 1e-30], 1), (6008, [0.0, 2e30], 1)]
    out = got(embedding_dedup.report(vectors(spark, rows), block=50))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out) == linked(rows)
    assert sum(r["n_links"] for r in out) > 3 * 120 * 119


def test_embedding_dedup_hot_copies_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(900)] + [(1000 + i, [math.cos(i), math.sin(i), 0.0], 1) for i in range(60)]
    out = {r["vec_id"]: r for r in got(embedding_dedup.report(vectors(spark, rows)))}
    assert {(out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) for i in range(900)} == {(899, 0, i) for i in (True, False)}
    empty = embedding_dedup.report(vectors(spark, rows).limit(0))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0
    alone = got(embedding_dedup.report(vectors(spark, [(1, [1.0], None), (2, None, 1)])))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in alone) == [(1, 0, 1, True), (2, 0, 2, True)]


# --- importance resampling

DOC = "doc_id bigint, text string, lang string, rank int, score string, block int, at int, digit int, weight string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "s", 2, 3, 4, "w") for i, t in rows], DOC)


def drawn(docs, target, runs=1, buckets=10_000, percent=10, least=20):
    """Brute force: (doc_id, n_features, weight, score) of every row, and the drawn (rank, doc_id, score)."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lower(t)).split(" ")
    words = lambda t: [w for w in split(t) if w]
    runs_of = lambda w: [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
    feats = lambda t: runs_of(words(t))
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in feats(x)), Counter(bucket(f) for x in target for f in feats(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, x in docs:
        f = feats(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return Counter(r[:4] for r in rows), [(k + 1, r[0], r[3]) for k, r in enumerate(able[: percent * len(able) // 100])]


@pytest.mark.parametrize("runs,percent", [(1, 10), (2, 60)])
def test_resampling(spark, runs, percent):
    rng = np.random.default_rng(2)
    vocabulary = ["Alpha", "beta", "GAMMA", "delta7", "é漢", "don't", "x-y", "zeta", "No", "Ünï"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 60)))) for i in rng.permutation(400)]
    docs += [(2**62, docs[0][1] * 3), (-(2**62) - 9, docs[1][1] * 9), (None, docs[2][1] * 4), (None, None), (401, ""), (402, " \n"), (403, "word " * 50_000), *[(7, "same " * 30)] * 3]
    target = ["alpha delta7 zeta " * 20, None, "", "don't"]
    out = got(resampling.report(documents(spark, docs), documents(spark, list(enumerate(target))), percent=percent, runs=runs))
    rows, ranks = drawn(docs, target, runs, percent=percent)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in out) == rows
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in out if r["rank"] is not None) == ranks


def test_radix_sort_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 100)
    monkeypatch.setattr(resampling, "DIGIT_BITS", 3)
    ids = spark.range(0, 3000, 1, 7).select((F.col("id") * 7919 % 3001 - 1500).alias("doc_id"))
    rows = ids.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(40)) - 20).alias("score"))
    out = resampling.radix_ranks(rows).collect()
    want = sorted(((r["score"], r["doc_id"]) for r in out), key=lambda r: (-r[0], r[1]))
    assert [(r["score"], r["doc_id"]) for r in sorted(out, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in out) == list(range(3000))


def test_resampling_empty(spark):
    docs = documents(spark, [(1, "a " * 30)])
    none = resampling.report(docs.limit(0), docs)
    assert none.columns == ["doc_id", "n_features", "weight", "score", "rank"] and none.count() == 0
    assert [r["rank"] for r in got(resampling.report(docs, docs.limit(0), percent=100))] == [1]
