"""Many matches in one text, parts of runs, words that no piece covers, clashing names, equal ids, and the whole pipeline."""

import hashlib
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from indexspark.llm import common, decontaminate, exact_dedup, language_id, mixing, pii, secret_scan, simhash, toxicity
from indexspark.llm import spans as S

SF = "/root/testdata/sf0.001"
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, __id string, __hash int, __spans array<int>, __row string, row int, kept boolean, component int, `a.b` string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 2, [3], "r", 4, True, 5, "d") for i, t, s in rows], ODD)


def test_fifty_thousand_matches_in_one_text(spark):
    n = 50_000
    text = " ".join(f"token=abcdefghij{i:06d} a{i}@example.com" for i in range(n // 2))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    at = time.time()
    base = secret_scan.base_spans(F.col("text"))["assign"]
    got = df.select(S.listed([("assign", base)]).alias("s")).first().s.split(",")
    step = [f"assign:{p}:{p + 22}" for p, part in _places(text) if part.startswith("token")]
    assert got == step
    mails = df.select(pii.base_spans(F.col("text"))["email"].alias("m")).select(F.size("m").alias("n"), F.size(S.apart(F.col("m"), F.col("m"))).alias("none")).first()
    assert (mails.n, mails.none) == (n // 2, 0)
    assert time.time() - at < 60


def _places(text):
    at = 0
    for part in text.split(" "):
        yield at, part
        at += len(part) + 1


def test_apart_and_outside_match_brute_force(spark):
    import random

    r = random.Random(3)
    for _ in range(6):
        cuts = sorted(r.sample(range(200), 40))
        apart = [(cuts[i], cuts[i + 1]) for i in range(0, 40, 2) if r.random() < 0.8]  # in order, not overlapping
        wild = [(a, a + r.randint(1, 30)) for a in r.sample(range(180), 15)]
        some = sorted((a, a + r.randint(1, 25)) for a in r.sample(range(180), 20))
        df = spark.createDataFrame([(some, wild, apart)], "a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>, c array<struct<start:int,end:int>>")
        whole = F.transform("a", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("t").alias("found"), s["start"].alias("of")))
        row = df.select(S.apart(F.col("a"), F.col("b")).alias("x"), S.outside(whole, F.col("c")).alias("y")).first()
        assert [tuple(s) for s in row.x] == [s for s in some if not any(o[0] < s[1] and s[0] < o[1] for o in wild)]
        want = []
        for start, end in some:
            left = [p for p in range(start, end) if not any(a <= p < b for a, b in apart)]
            runs = [p for p in left if p - 1 not in left]
            want += [(p, next(q for q in range(p, end + 1) if q not in left)) for p in runs]
        assert [(s.start, s.end) for s in row.y] == want


def test_parts_of_a_run_outside_base_spans_are_scored(spark):
    secret = "Zx9Qv7Lm2Rt8Kp4Wd6Hs1Yb3Nc5Jg0F"
    plain = "configuration_manager_service_name"
    docs = spark.createDataFrame([(1, f"AKIAABCDEFGHIJKLMN/{secret} end"), (2, f"AKIAABCDEFGHIJKLMN/{plain}"), (3, f"é {secret}")], "doc_id bigint, text string")
    sample = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id > 3")
    out = {r.doc_id: r.spans for r in secret_scan.report(docs.unionByName(sample)).where("doc_id <= 3").collect()}
    assert out[1] == f"access:0:18,markov:18:{19 + len(secret)}"
    assert out[2] == "access:0:18"
    assert out[3] == f"markov:2:{2 + len(secret)}"


# --- language identification


def test_words_that_no_piece_covers_have_finite_scores(spark):
    vocabulary = [b"a", b"ab", b"the", b"house"]
    lookup = language_id.Lookup(vocabulary)
    import numpy as np

    p = np.array([[0.1, 0.2], [0.3, 0.1], [0.4, 0.6], [0.2, 0.1]])
    model = language_id.Model(["de", "en"], vocabulary, p)
    hard = "漢" * 3400  # more than 10,000 bytes
    df = spark.createDataFrame([(1, f"the house {hard}"), (2, hard), (3, "the ab"), (4, "1234"), (5, None)], "doc_id bigint, text string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model).collect()}
    assert all(0 <= s <= 1 for _, s in out.values()) and out[4] == out[5] == ("und", 0.0)
    assert out[2][1] == pytest.approx(0.5) and out[3][0] == "de" and out[1][0] == "de"

    def log_word(w, k):  # brute force over all segmentations
        ways = [1.0] + [0.0] * len(w)
        for end in range(1, len(w) + 1):
            ways[end] = ways[end - 1] * language_id.UNKNOWN + sum(ways[end - len(v)] * p[i, k] for i, v in enumerate(vocabulary) if end >= len(v) and w[end - len(v) : end] == v)
        return np.log(ways[-1])

    text = "the ab house abx a"
    totals = [sum(log_word(w.encode(), k) for w in text.split()) for k in (0, 1)]
    got = language_id.predict(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    assert got.score == pytest.approx(1 / (1 + np.exp(-abs(totals[0] - totals[1])))) and got.lang_pred == ("de" if totals[0] >= totals[1] else "en")
    assert language_id.word_scores(pa.array(["house"]), lookup, p)[0] == pytest.approx([log_word(b"house", 0), log_word(b"house", 1)])


# --- mixing: documents without ids


def test_mixing_meets_targets_where_ids_are_equal_or_missing(spark):
    rows = [(None, f"n{i} " * (5 + i % 9), "a") for i in range(2000)] + [(7, f"s{i} " * (5 + i % 9), "b") for i in range(900)] + [(i, "w " * 10, "c") for i in range(300)]
    out = mixing.mix(odd(spark, rows))
    by = {r.source_size: (r.target, r.taken) for r in out.groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()}
    assert len(by) == 3 and all(abs(taken - target) <= 20 for target, taken in by.values())
    assert sum(0.05 < target / size % 1 < 0.95 for size, (target, _) in by.items()) >= 1


# --- clashing names, and the pipeline


def stub(docs, labels):
    return docs.where(~F.coalesce(F.col("text").contains("insult"), F.lit(False)))


LEAK = "one two three four five six seven eight nine ten eleven"


@pytest.fixture()
def corpus(spark, monkeypatch, tmp_path):
    near = " ".join(f"word{i}" for i in range(400))
    rows = [(1, None, None), (2, "", "a"), (3, "same text here", "a"), (4, "same text here", "b"), (4, "same text here", "b"), (None, "same text here", "b"), (5, near, "a"), (6, near + " more", "b"),
            (7, f"a b {LEAK} c", "a"), (8, "an insult it is", "a"), (None, "clean without an id", "a"), (None, "another without an id", "a"), (9, "Ünï códe " * 50, "c"), (10, "plain words " * 30, "a")]
    monkeypatch.setattr(toxicity, "keep_clean", stub)
    sf = str(tmp_path)
    odd(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([("i1", LEAK), (None, None)], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, rows


def test_pipeline_against_brute_force(spark, corpus):
    sf, rows = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        docs = common.materialize(out, name)
        kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    want = [(i, t) for i, t, _ in rows if "insult" not in (t or "")]
    assert kept["toxicity"] == sorted(want, key=str)
    groups = {}
    for i, t in want:  # of equal texts the largest id
        groups[t or ""] = max(groups.get(t or "", (-2, None)), (-1 if i is None else i, t), key=lambda x: x[0])
    want = [(None if i == -1 else i, t) for i, t in groups.values()]
    assert kept["exact_dedup"] == sorted(want, key=str)
    prints = {(i, t): simhash.fingerprint((t or "").encode()) for i, t in want}
    drop = {(i, t) for (i, t), p in prints.items() for (j, u), q in prints.items() if j is not None and (i is None or j < i) and bin((p ^ q) & (2**64 - 1)).count("1") <= 3}
    want = [x for x in want if x not in drop]
    assert kept["simhash_near_dedup"] == sorted(want, key=str) and drop
    want = [(i, t) for i, t in want if LEAK not in (t or "")]
    assert kept["benchmark_decontamination"] == sorted(want, key=str)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*columns, "mix_copies"]
    assert {(r.doc_id, r.text) for r in out.collect()} <= set(want) and out.where("mix_copies < 1 or mix_copies > 2").count() == 0


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    sf, _ = corpus
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_remove_spans_with_clashing_names(spark, corpus):
    sf, _ = corpus
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate.remove_spans(docs, bench)
    assert out.columns == docs.columns and out.where("doc_id = 7").first().text == "a b c"
    assert exact_dedup.dedup(docs).columns == docs.columns
    assert hashlib.sha256(b"").hexdigest() in {r.text_sha256 for r in exact_dedup.exact_dedup(docs).collect()}
