"""Secret scan: fixed patterns, and two character Markov models compared by their log-likelihood ratio.

The patterns (assignments, access keys, hexadecimal runs) give the base spans. Besides, every long run of key characters
is scored by two first-order Markov models over single characters, one of random strings and one of ordinary
identifiers; runs whose log-likelihood ratio exceeds MIN_RATIO become spans of kind ``markov``. Base spans always stand: of
a run that touches some, the parts outside them are scored, each by itself, if they have MIN_LENGTH characters.

The models are trained from labelled samples: random strings are those that the patterns find in SAMPLE_DOCS documents
(those with the smallest hash of their ids) and SAMPLE_DOCS random strings in three alphabets; ordinary identifiers are
the other words of these documents and identifiers joined from them. Only transition counts, whose number is bounded by
the alphabet, reach the driver; scoring is part of the one pass over the texts and uses Spark expressions only.

Defined cases: a null text is empty and has no spans; rows repeated are scanned each; an empty table gives an empty
result; only doc_id and text are read, whatever other columns there are; texts are read whole at any length.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import spans as S

SAMPLE_DOCS = 4000
MIN_RATIO = 15.0
MIN_LENGTH = 20
_KEY = "A-Za-z0-9+/_=-"
_VALUE = "[A-Za-z0-9+/_.=-]+"
#: Of a run of several, the first match takes all it can and is then tested: so no {12,} here.
ASSIGN = f"(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?{_VALUE}"
ASSIGN_VALUE = f"(?s)^(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?({_VALUE})$"
ACCESS = "AKIA[A-Z0-9]{14,}+"
HEX = "[0-9a-f]{16,}+"
RUN = f"(?:\\G|(?<![{_KEY}]))[{_KEY}]{{{MIN_LENGTH},}}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_A = len(ALPHABET) + 1


def base_spans(text: Column) -> dict[str, Column]:
    assign = S.matches(text, ASSIGN, text.rlike(f"(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"), ASSIGN_VALUE)
    return {
        "assign": F.filter(assign, lambda s: F.length(s["part"]) >= 12),
        "access": S.matches(text, ACCESS, text.contains("AKIA") & text.rlike(ACCESS)),
        "hex": S.matches(text, HEX, text.rlike("[0-9a-f]{16}")),
    }


def _places(word: Column) -> Column:
    """The numbers of a word's characters in ALPHABET (0: another)."""
    return F.transform(F.split(word, ""), lambda c: F.when(c == "", 0).otherwise(F.position(c, F.lit(ALPHABET))))


def labelled(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """(word, random): the training samples."""
    ids = docs.where("doc_id is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = C.materialize(ids.distinct(), "secret-sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    texts = C.materialize(texts, "secret-texts")  # else the optimizer moves the scan below the join, to all texts
    text = F.col("text")
    base = base_spans(text)
    secrets = F.concat(*[F.transform(base[k], lambda s: s["part"]) for k in base])
    words = F.regexp_extract_all(text, F.lit(f"(?<![{_KEY}])[{_KEY}]{{3,}}+"), F.lit(0))
    both = texts.select(secrets.alias("secrets"), F.filter(words, lambda w: ~w.rlike("[0-9a-f]{16}|AKIA[A-Z0-9]{14}")).alias("words"))
    joined = F.transform(F.col("words"), lambda w, i: F.when(i % 3 == 0, w).when(i % 3 == 1, F.concat_ws("_", w, F.element_at("words", 1))).otherwise(F.concat(w, F.initcap(F.element_at("words", -1)))))
    found = both.select(F.explode("secrets").alias("word"), F.lit(1).alias("random"))
    plain = both.where("size(words) > 0").select(F.explode(joined).alias("word"), F.lit(0).alias("random"))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    coded = F.base64(F.unhex(digest))
    made = docs.sparkSession.range(most).select(F.explode(F.array(coded, F.regexp_replace(coded, "[+/=]", ""), F.upper(F.regexp_replace(coded, "[+/=]", "")), digest)).alias("word"), F.lit(1).alias("random"))
    return found.unionAll(plain).unionAll(made)


def train(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[float]:
    """The ratio of each transition, row by row of ALPHABET (row 0: other characters and the start)."""
    pairs = labelled(docs, most).select("random", F.concat(F.array(F.lit(0)), _places(F.col("word"))).alias("p"))
    steps = pairs.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.element_at("p", i) * _A + F.element_at("p", i + 1))).alias("step"))
    count = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count(F.lit(1)).alias("n")).collect()}
    row = {(k, a): sum(count.get((k, a * _A + b), 0) for b in range(_A)) for k in (0, 1) for a in range(_A)}
    share = lambda k, a, b: (count.get((k, a * _A + b), 0) + 0.5) / (row[k, a] + 0.5 * _A)
    return [math.log(share(1, a, b) / share(0, a, b)) for a in range(_A) for b in range(_A)]


def ratio(word: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a word: random string against identifier."""
    held = F.from_json(F.lit(json.dumps([round(x, 5) for x in table])), "array<double>")
    steps = F.concat(F.array(F.lit(0)), _places(word))
    added = F.aggregate(steps, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")), lambda s, x: F.struct((s["sum"] + F.when(s["last"] < 0, F.lit(0.0)).otherwise(F.element_at(held, s["last"] * _A + x + 1))).alias("sum"), x.alias("last")))
    return added["sum"]


def scan(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id and one array of (start, end, found, part) for each kind: assign, access, hex, markov."""
    table = train(docs, most)
    text = C.text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), *[c.alias(k) for k, c in base_spans(text).items()])
    runs = S.matches(F.col("text"), RUN, F.col("text").rlike(f"[{_KEY}]{{{MIN_LENGTH}}}"))
    parts = F.transform(runs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), s["start"].alias("of")))
    for kind in ("assign", "access", "hex"):
        parts = S.outside(parts, F.col(kind))
    long = F.filter(parts, lambda s: s["end"] - s["start"] >= MIN_LENGTH)
    taken = lambda s: F.substring(s["found"], s["start"] - s["of"] + 1, s["end"] - s["start"])
    spans = F.transform(long, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), taken(s).alias("found"), taken(s).alias("part")))
    rows = rows.select("doc_id", "assign", "access", "hex", spans.alias("runs"))
    return rows.select("doc_id", "assign", "access", "hex", F.filter("runs", lambda s: ratio(s["found"], table) >= MIN_RATIO).alias("markov"))


def report(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    base = [(k, F.col(k)) for k in ("assign", "access", "hex")]
    found = scan(docs, most)
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in base]
    return found.select("doc_id", *counts, F.sha2(S.listed(base), 256).alias("base_sha256"), S.listed([*base, ("markov", F.col("markov"))]).alias("spans"))
