"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: the sources, in code point order with null last, weigh 5, 2, 1, 5, ... and share a
budget; a target stops at a multiple of its source's size and the excess is shared anew by weight. A document then gets
target / source size copies on average: the whole part for certain, the fraction by a Pareto sample of fixed size. Its
rank is its random odds u/(1-u), u a hash of id and text, over its inclusion odds p/(1-p), p the fraction. The lowest ranks
are taken up to the words that are left to the target; a second round fills the gap that the first document beyond it
leaves with later documents that fit.

No task ever sorts a source. The rank at which a source's quota is reached is found by a histogram of 4,096 rank
intervals, then one of 4,096 parts of the interval met, then exactly among the few ranks of that part.

Defined cases: a null text has size 0 and is never more than size 0 in the mix; null is a source of its own; documents
of equal rank (rows repeated with id and text) are taken together or not at all; an empty table gives an empty result.
Only doc_id, text and source are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MOST_COPIES = 2
SEED = "mix-1"
PARTS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def uniform() -> Column:
    """A number in (0, 1) from the document's id and text, the same at each run."""
    seeded = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(C.text_or_empty().cast("binary")))
    return (F.conv(F.substring(F.md5(seeded.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size and u of every row, and what else is asked for."""
    source = F.col("source").cast("string").alias("source")
    return docs.select("doc_id", source, word_count(C.text_or_empty()).alias("size"), uniform().alias("u"), *more)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, whole (certain copies) and quota (words left for the sample), one row per source."""
    per_source = C.materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # the sources of a mix are the rows of its configuration; one row each is numbered here, never documents
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = C.materialize(per_source.withColumn("weight", weight), "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    capped, level = -1, 0.0
    above = lambda level: F.lit(float(MOST_COPIES)) * F.col("source_size") < F.lit(level) * F.col("weight")
    while True:
        n, full, open_weight = weighed.agg(
            F.count_if(above(level)), F.sum(F.when(above(level), F.col("source_size"))), F.sum(F.when(~above(level), F.col("weight")))
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, float(BUDGET_PERCENT * total - 100 * MOST_COPIES * (full or 0)) / float(100 * open_weight)
    target = F.when(above(level), F.lit(float(MOST_COPIES)) * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))
    out = weighed.withColumn("target", target.cast("double"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("whole", whole).withColumn("quota", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    return C.materialize(out.select("source", "source_size", "target", "whole", "quota"), "targets")


def rank(u: Column, quota: Column, source_size: Column) -> Column:
    """Random odds over inclusion odds."""
    p = quota.cast("double") / source_size
    return (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))


def _reached(rows: DataFrame, part: Column, quota: DataFrame) -> DataFrame:
    """Per source the first part whose words, with those of all parts before, exceed the quota; and the words before it."""
    parts = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
    over = parts.withColumn("up_to", up_to).join(quota, F.expr("source <=> of")).where("up_to > quota - before")
    first = F.min_by(F.struct("part", (F.col("up_to") - F.col("words") + F.col("before")).alias("before")), "part")
    return C.materialize(over.groupBy("source").agg(first.alias("x")).select(F.col("source").alias("of"), F.col("x.part").alias("at"), F.col("x.before").alias("before")), "reached")


def cut(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """(of, bound, words): the largest rank of each source up to which its rows fit its quota, and their words.

    ``rows``: source, rank, size; ``quota``: of, quota. A source that fits as a whole gets an infinite bound.
    """
    scaled = F.col("rank") / (F.lit(1.0) + F.col("rank"))
    coarse = F.floor(scaled * F.lit(float(PARTS)))
    fine = F.floor(scaled * F.lit(float(PARTS * PARTS)))
    start = quota.withColumn("before", F.lit(0).cast("long"))
    one = _reached(rows, coarse, C.small(start))
    met = rows.join(C.small(one.select("of", "at")), F.expr("source <=> of")).where(coarse == F.col("at")).drop("of", "at")
    two_quota = quota.join(one.select(F.col("of").alias("__of"), "before"), F.expr("of <=> __of")).drop("__of")
    two = _reached(met, fine, C.small(two_quota))
    last = met.join(C.small(two.select("of", "at")), F.expr("source <=> of")).where(fine == F.col("at")).drop("of", "at")
    ranks = last.groupBy("source", "rank").agg(F.sum("size").alias("words"))
    ranks = ranks.withColumn("up_to", F.sum("words").over(Window.partitionBy("source").orderBy("rank")))
    three_quota = quota.join(two.select(F.col("of").alias("__of"), "at", "before"), F.expr("of <=> __of"), "left").drop("__of")
    fits = ranks.join(C.small(C.materialize(three_quota, "quota")), F.expr("source <=> of")).where("up_to + before <= quota")
    inside = fits.groupBy("source").agg(F.max("rank").alias("bound"), F.max(F.col("up_to")).alias("inner"))
    sums = three_quota.join(inside, F.expr("source <=> of"), "left")
    return sums.select(
        "of", F.col("at").alias("part"), F.col("bound"),
        F.when(F.col("at").isNotNull(), F.col("before") + F.coalesce("inner", F.lit(0))).alias("words"),
    )


def _within(rank_: Column, part: str, bound: str) -> Column:
    """Whether a rank is inside what ``cut`` found; a source without a part fits as a whole."""
    fine = F.floor(rank_ / (F.lit(1.0) + rank_) * F.lit(float(PARTS * PARTS)))
    return F.col(part).isNull() | (fine < F.col(part)) | ((fine == F.col(part)) & F.coalesce(rank_ <= F.col(bound), F.lit(False)))


def plan(sizes: DataFrame) -> DataFrame:
    """All that decides a document's copies, one row per source: target, whole copies and the bounds of both rounds."""
    goal = targets(sizes)
    ranked = _ranked(sizes, goal)
    live = goal.where("quota > 0").select(F.col("source").alias("of"), "quota")
    one = C.materialize(cut(ranked, live), "round-1")
    gap = one.join(live.withColumnRenamed("of", "__of"), F.expr("of <=> __of")).select("of", "part", "bound", (F.col("quota") - F.col("words")).alias("gap"))
    gap = C.materialize(gap.where("part is not null"), "gaps")
    later = ranked.join(C.small(gap), F.expr("source <=> of")).where("size <= gap").where(~_within(F.col("rank"), "part", "bound"))
    later = C.materialize(later.select("source", "rank", "size"), "later")
    two = cut(later, gap.select("of", F.col("gap").alias("quota")))
    fill = gap.join(two.select(F.col("of").alias("__of"), F.col("part").alias("part2"), F.col("bound").alias("bound2")), F.expr("of <=> __of"), "left").drop("__of")
    return C.materialize(goal.join(fill, F.expr("source <=> of"), "left").drop("of"), "plan")


def _ranked(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    g = C.small(goal.where("quota > 0").select(F.col("source").alias("of"), "quota", "source_size"))
    rows = sizes.join(g, F.expr("source <=> of"))
    return rows.select("source", "size", rank(F.col("u"), F.col("quota"), F.col("source_size")).alias("rank"))


def copies(rows: DataFrame, made: DataFrame) -> DataFrame:
    """``rows`` (at least source, size, u) with source_size, target and copies: how often the mix takes each row."""
    p = C.small(made.select(*[F.col(c).alias(f"__{c}") for c in made.columns]))
    r = F.when(F.col("__quota") > 0, rank(F.col("u"), F.col("__quota"), F.col("__source_size")))
    first = _within(r, "__part", "__bound")
    second = F.col("__gap").isNotNull() & (F.col("size") <= F.col("__gap")) & _within(r, "__part2", "__bound2")
    drawn = F.when(r.isNotNull() & (first | second), 1).otherwise(0)
    joined = rows.join(p, rows["source"].eqNullSafe(F.col("__source")))
    return joined.select(*rows.columns, F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__whole") + drawn).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    sizes = C.materialize(sized(docs), "sizes")
    out = copies(sizes, plan(sizes))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns and mix_copies (an older column of that name gives way)."""
    made = plan(C.materialize(sized(docs), "sizes"))
    names = [c for c in docs.columns if c != "mix_copies"]
    rows = sized(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    out = copies(rows, made).where("copies > 0")
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("copies").alias("mix_copies"))
