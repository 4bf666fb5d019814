"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, met by every window of every text.

Texts and items are normalised alike: A-Z in lower case, words are runs of ASCII letters, digits and non-ASCII
characters. The windows of all items, n words each (an item of fewer words is one window), form the hash set. Each
document's windows are looked up in it as the words themselves, so a hit is verified by the lookup's comparison of the
whole window. The words of overlapping hits are counted once.

The hash set is broadcast only up to a checked number of windows; a larger benchmark is joined by a shuffle. Where a
window belongs to several items, the hash set has one row with all of them.

Defined cases: a null text has no words; an item with a null text has no window; an item without an id is met like any
other, but there is no id to list; rows repeated with the same id and text are looked up as one document and answered
each; without documents or benchmark nothing is hit; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

N = 10
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: A-Z are words' characters in WORD, as they are lower-cased only after the split (the same words, less work).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ITEMS = "array()"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(tokens: Column, length: int) -> Column:
    """Array of (at, n, window) for all runs of ``length`` words."""
    at = F.sequence(F.lit(0), F.size(tokens) - F.lit(length))
    made = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(length).alias("n"), F.array_join(F.slice(tokens, i + 1, length), " ").alias("window")))
    none = F.array().cast("array<struct<at:int,n:int,window:string>>")
    return F.when(F.size(tokens) >= length, made).otherwise(none)


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """window, n, items (ids as sorted strings; none for items without an id): one row per distinct window, written once."""
    tokens = benchmark.select(F.col("item_id").cast("string").alias("item"), words(C.text_or_empty()).alias("tokens")).where("size(tokens) > 0")
    short = tokens.where(F.size("tokens") < n).select("item", F.array_join("tokens", " ").alias("window"), F.size("tokens").alias("n"))
    full = tokens.select("item", F.inline(windows(F.col("tokens"), n))).select("item", "window", "n")
    grouped = full.unionAll(short).groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return C.materialize(grouped, "benchmark-windows")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, text_hash, n_rows, n_words, n_hit, n_items, items (sorted), spans (start, end of merged hits, in words).

    One row for each id and text, with the number of rows that have them.
    """
    known = benchmark_windows(benchmark, n)
    lengths = sorted({n, *(r[0] for r in known.select("n").distinct().collect())})  # 1 to n at most
    base = docs.select("doc_id", C.text_hash().alias("text_hash"), words(C.text_or_empty()).alias("tokens"))
    mark = F.array(F.struct(F.lit(-1).alias("at"), F.size("tokens").alias("n"), F.lit(None).cast("string").alias("window")))
    looked_up = base.select("doc_id", "text_hash", F.inline(F.concat(mark, *[windows(F.col("tokens"), k) for k in lengths])))
    met = looked_up.join(C.small(known.select("window", "items")), "window", "left").where("at < 0 or items is not null")
    hit = F.col("at") >= 0
    per_doc = met.groupBy("doc_id", "text_hash").agg(
        F.count_if(~hit).alias("n_rows"),
        F.max(F.when(~hit, F.col("n"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("at", (F.col("at") + F.col("n")).alias("end"))))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    grow = lambda done, h: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= h["at"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], h["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(F.struct(h["at"].alias("start"), h["end"].alias("end")))))
    spans = F.when(F.size("hits") > 0, F.aggregate("hits", none, grow)).otherwise(none)
    out = per_doc.withColumn("spans", spans)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "text_hash", "n_rows", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    answers = scan(docs, benchmark, n).select("n_rows", "doc_id", "n_words", "n_hit", "n_items", ids, (F.col("n_hit") > 0).alias("contaminated"))
    return answers.select("*", F.explode(F.sequence(F.lit(1), "n_rows")).alias("row")).drop("n_rows", "row")


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    hit = C.materialize(scan(docs, benchmark, n).where("n_hit > 0").select("doc_id", "text_hash"), "contaminated")
    return C.keep_other_rows(docs, hit)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the hit words, and the separators before them, cut out of their texts."""
    id_, hash_, spans_ = (C.free_name(docs.columns, n) for n in ("__id", "__hash", "__spans"))
    hit = scan(docs, benchmark, n).where("n_hit > 0").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(spans_))
    hit = C.materialize(hit, "spans")
    gap = WORD.replace("[^", "[").rstrip("+")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"{gap}*{WORD}"), F.lit(0))
    left = F.filter(pieces, lambda _, i: ~F.exists(spans_, lambda s: (s["start"] <= i) & (i < s["end"])))
    cut = F.concat(F.array_join(left, ""), F.regexp_extract("text", f"{gap}*$", 0))
    joined = docs.join(hit, C.same_row(docs, id_, hash_), "left")
    return joined.select(*[F.when(F.col(spans_).isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])
