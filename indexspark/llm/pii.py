"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Base spans come from fixed patterns and tests (e-mail, IP address, card with Luhn check, phone). Besides, three loose
generators propose overlapping candidates (names and hosts round an at sign, plain or written out; runs of digits and
their separators; dotted or coloured groups). Gradient-boosted trees score each candidate by its format and its context;
per generator a threshold, calibrated on documents that the trees have not seen, selects what is added. Base spans always
stay; a candidate that touches one is not added.

No labelled personal data is given, so the labels are made from SAMPLE_DOCS documents (those with the smallest hash of
their ids): each base match is written anew, where it stood and between blanks, as people write it past the patterns (at and dot spelt out,
national numbers, cards in other separators, addresses in hexadecimal groups), which are the positives, and its digits as
dates, versions, amounts, ranges, book numbers, times, plain numbers and cards that fail the Luhn test, which are
negatives. So are the sample's own candidates apart from base spans. At most SAMPLE_ROWS candidates are kept, those with
the smallest hash. The fitted trees are written as CASE expressions, so that all scoring is part of one pass over the
texts in Spark expressions.

Defined cases: a null text is empty and has no spans; rows repeated are scanned each; an empty table, or a sample
without one of the labels, adds nothing to the base; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import spans as S

SAMPLE_DOCS, SAMPLE_ROWS = 6000, 20_000
TREES, DEPTH, STEP, LEAF = 14, 4, 0.3, 20  # a leaf of few rows would be a form that the corpus holds unlabelled
PRECISION, LEAST_SCORE = 0.95, 0.6
AROUND = 24
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_HOST = "[\\p{L}\\p{N}-]{1,63}+"
#: Loose generators by name.
LOOSE = {
    "near_email": f"[^\\s@<>,;()\\[\\]]{{1,64}}+(?:@|\\x20?[(\\[](?:at|AT)[)\\]]\\x20?){_HOST}(?:(?:\\.|\\x20?[(\\[](?:dot|DOT)[)\\]]\\x20?){_HOST})*+",
    "near_number": "[+(]?[0-9][0-9\\x20()./-]{5,40}[0-9]",
    "near_address": "[0-9A-Fa-f]{1,4}(?:[.:]{1,2}[0-9A-Fa-f]{1,4}){3,7}+",
}
CONTEXTS = {
    "says_mail": "(?i)e-?mail|contact|write|@",
    "says_phone": "(?i)phone|tel|call|fax|mobile",
    "says_card": "(?i)card|visa|pay|account|iban",
    "says_host": "(?i)host|server|addr|ip\\b",
}


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    each = F.reverse(F.split(_digits(found), ""))
    worth = F.transform(F.filter(each, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return S.total(worth) % 10 == 0


def base_spans(text: Column, around: int = 0) -> dict[str, Column]:
    n = lambda s: F.length(_digits(s["found"]))
    return {
        "email": S.matches(text, EMAIL, text.contains("@"), around=around),
        "ip": F.filter(S.matches(text, IP, text.rlike("[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]"), around=around), lambda s: s["found"].rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")),
        "card": F.filter(S.matches(text, CARD, text.rlike("[0-9](?:[\\x20-]?[0-9]){13}"), around=around), lambda s: n(s).between(14, 19) & F.when(n(s).between(14, 19), luhn(s["found"])).otherwise(False)),
        "phone": F.filter(S.matches(text, PHONE, text.contains("+"), around=around), lambda s: n(s).between(10, 15)),
    }


def candidates(text: Column) -> dict[str, Column]:
    look = {"near_email": text.rlike("@|[(\\[](?:at|AT)[)\\]]"), "near_number": text.rlike("[0-9][0-9\\x20()./-]{5}"), "near_address": text.rlike("[0-9A-Fa-f][.:]{1,2}[0-9A-Fa-f]")}
    return {k: S.matches(text, p, look[k], around=AROUND) for k, p in LOOSE.items()}


def features(span: Column, kind: int) -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    found, before, after = span["found"], span["before"], span["after"]
    count = lambda p: F.length(F.regexp_replace(found, f"[^{p}]", ""))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = {
        "kind": F.lit(float(kind)), "length": F.length(found), "digits": count("0-9"), "letters": count("A-Za-z"), "dots": count("."), "dashes": count("\\-"),
        "blanks": count("\\x20"), "brackets": count("()"), "ats": count("@"), "colons": count(":"), "plus": yes(found.startswith("+")),
        "groups": F.size(F.split(found, "[^0-9]+")), "domain": yes(found.rlike("@[A-Za-z0-9-]+\\.[A-Za-z]{2,}$")), "luhn": yes(luhn(found)),
        "slashes": count("/"), "first_group": F.length(F.regexp_extract(found, "[0-9]+", 0)), "last_group": F.length(F.regexp_extract(found, "([0-9]+)[^0-9]*$", 1)),
        "spelt_at": yes(found.rlike("[(\\[](?:at|AT)[)\\]]")), "host_letters": F.length(F.regexp_extract(found, "([A-Za-z]*)$", 1)),
        "joined_before": yes(F.substring(before, -1, 1).rlike("[A-Za-z0-9]")), "joined_after": yes(after.rlike("[A-Za-z0-9]")),
    }
    return {k: v.cast("double") for k, v in out.items()} | {k: yes(before.rlike(p)) for k, p in CONTEXTS.items()}


def _featured(found: Column, n: int) -> Column:
    fields = lambda s: [s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")]
    return F.transform(found, lambda s: F.struct(F.lit(n).alias("which"), *fields(s), *[v.alias(k) for k, v in features(s, n).items()]))


def _proposed(found: dict[str, Column]) -> Column:
    """All candidates with their features."""
    return reduce(lambda a, b: F.concat(a, b), [_featured(spans, n) for n, spans in enumerate(found.values())])


def _email_forms(found: Column) -> tuple[list[Column], list[Column]]:
    like, unlike = [], []
    plain = F.regexp_replace(found, "[0-9]", "")
    short = F.regexp_replace(plain, "^([^.@]+)[^@]*@(?:.*\\.)?([^.@]+\\.[^.@]+)$", "$1@$2")
    for address in (found, plain, short):  # else digits and long hosts, where all have them, are what it learns
        name, host = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
        like += [F.concat(name, F.lit(at), host if dot == "." else F.regexp_replace(host, "\\.", dot))
                 for at, dot in (("(at)", "."), (" [at] ", "."), ("[at]", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "))]
        unlike += [F.concat(name, F.lit("@"), F.substring_index(host, ".", 1)), F.concat(name, F.lit(" (at) 12")),  # short and long ones
                   F.concat(name, F.lit("@"), F.translate(host, ".", "-")), F.concat(name, name, F.lit("(at)2024.12.31.1200"))]
    return like, unlike


def _number_forms(d: Column) -> list[Column]:
    """Numbers of ten digits or more as what is not personal."""
    at = lambda i, n: F.substring(d, i, n)
    as_ = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    y, m, day = at(1, 2), as_("0", at(3, 1)), as_("1", at(4, 1))
    return [
        as_("20", y, "-", m, "-", day), as_(day, ".", m, ".20", y), as_(m, "/", day, "/20", y), as_("20", y, "-20", at(5, 2)),
        as_("20", y, "-", m, "-", day, " ", at(5, 2)), as_(at(1, 1), ".", at(2, 2), ".", at(4, 4)), as_(at(1, 2), ".", at(3, 3), ".", at(6, 3)),
        as_(at(1, 6), ".", at(7, 2)), at(1, 8), at(1, 10), as_(at(1, 10), at(3, 2)), as_("978-", at(1, 1), "-", at(2, 2), "-", at(4, 6), "-", at(10, 1)),
    ]


def _phone_forms(found: Column) -> tuple[list[Column], list[Column]]:
    d = F.substring(_digits(found), -10, 10)
    at = lambda i, n: F.substring(d, i, n)
    national = [F.concat(F.lit(a), at(1, 3), F.lit(b), at(4, 3), F.lit(c), at(7, 4)) for a, b, c in (("(", ") ", "-"), ("", " ", " "), ("", "-", "-"), ("", ".", "."))]
    area = F.concat(F.lit("(0"), at(1, 2), F.lit(") "), at(3, 4), F.lit("-"), at(7, 4))
    return [*national, area, F.concat(F.lit("0"), at(1, 3), F.lit("/"), at(4, 7))], _number_forms(d)


def _card_forms(found: Column) -> tuple[list[Column], list[Column]]:
    d = _digits(found)
    fours = lambda d, by: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{by}")
    other = F.concat(F.regexp_replace(d, "[0-9]$", ""), ((F.substring(d, -1, 1).cast("int") + 1) % 10).cast("string"))
    return [fours(d, "/"), fours(d, "."), fours(d, " / ")], [fours(other, "/"), fours(other, "."), other, *_number_forms(d)]


def _ip_forms(found: Column) -> tuple[list[Column], list[Column]]:
    part = [F.element_at(F.split(found, "\\."), i + 1).cast("int") for i in range(4)]
    pair = [F.lower(F.concat(*[F.lpad(F.hex(p), 2, "0") for p in two])) for two in (part[:2], part[2:])]
    sixty = [F.lpad((p % 60).cast("string"), 2, "0") for p in part]
    spelt = [F.concat(F.lit(a), pair[0], F.lit(":"), pair[1]) for a in ("2001:db8::", "fe80::1:", "2001:db8:0:0:", "2001:db8:85a3:8d3:1319:8a2e:")]
    return spelt, [F.concat_ws(":", F.lit("12"), *sixty[1:]), F.concat_ws(".", (part[0] % 100 + 300).cast("string"), *[p.cast("string") for p in part[1:]])]


_REWRITE = {"email": _email_forms, "ip": _ip_forms, "card": _card_forms, "phone": _phone_forms}


def _pieces(spans: Column, kind: str) -> Column:
    """A base match's forms, labelled, each with what stood round the match and between blanks."""

    def one(s: Column) -> Column:
        like, unlike = _REWRITE[kind](s["found"])
        forms = [F.struct(before.alias("before"), f.alias("form"), after.alias("after"), F.lit(label).alias("label"))
                 for before, after in ((s["before"], s["after"]), (F.lit(" "), F.lit(" "))) for label, fs in ((1.0, like), (0.0, unlike)) for f in fs]
        return F.array(*forms)

    return F.flatten(F.transform(spans, one))


def sample(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """which, label, fold and the features of the training candidates."""
    ids = docs.where("doc_id is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = C.materialize(ids.distinct(), "pii-sample")
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    rows = C.materialize(rows, "pii-texts")  # else the optimizer moves the scan below the join, to all texts
    rows = rows.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text"), AROUND).items()])
    made = rows.select("doc_id", F.explode(F.concat(*[_pieces(F.col(k), k) for k in BASE])).alias("p")).select("doc_id", "p.*")
    made = C.materialize(made, "pii-forms").withColumn("text", F.concat("before", "form", "after"))
    made = made.select("doc_id", "label", "form", F.length("before").alias("at"), F.explode(_proposed(candidates(F.col("text")))).alias("c"))
    plain = lambda found: F.regexp_replace(found, "[\\x20()]", "")
    meets = (F.col("c.start") < F.col("at") + F.length("form")) & (F.col("c.end") > F.col("at"))
    made = made.where(meets & ((F.col("label") == 0) | (plain(F.col("c.found")) == plain(F.col("form"))))).select("doc_id", "label", "c.*")
    rows = rows.select("doc_id", *[S.apart(c, F.concat(*BASE)).alias(k) for k, c in candidates(F.col("text")).items()])
    own = rows.select("doc_id", F.lit(0.0).alias("label"), F.explode(_proposed({k: F.col(k) for k in LOOSE})).alias("c")).select("doc_id", "label", "c.*")
    out = made.unionByName(own).withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5)
    out = out.orderBy(F.xxhash64("doc_id", "found", "start"), "doc_id", "found", "start", "label").limit(SAMPLE_ROWS)
    return C.materialize(out.drop("doc_id", "start", "end", "found"), "pii-candidates")


def _tree(node, at: Column, names: list[str]) -> Column:
    """A fitted tree as a CASE expression over the fields of ``at``."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    low, high = _tree(node.leftChild(), at, names), _tree(node.rightChild(), at, names)
    return F.when(at[names[split.featureIndex()]] <= F.lit(float(split.threshold())), low).otherwise(high)


class Trees:
    """Fitted trees and the threshold of each generator."""

    def __init__(self, model, names: list[str]):
        self.roots = [(float(w), t.rootNode()) for w, t in zip(model.treeWeights, model._java_obj.trees(), strict=True)]
        self.names, self.thresholds = names, [1.1] * len(LOOSE)

    def score(self, at: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [F.lit(w) * _tree(root, at, self.names) for w, root in self.roots])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def selects(self, at: Column) -> Column:
        least = F.element_at(F.array(*map(F.lit, self.thresholds)), at["which"] + 1)
        return self.score(at) >= least


def train(docs: DataFrame, most: int = SAMPLE_DOCS) -> Trees | None:
    """Boosted trees of four folds, thresholds of the fifth; None where a label is missing."""
    rows = sample(docs, most)
    seen = rows.where("fold <> 0")
    if seen.select("label").distinct().count() < 2:
        return None
    names = [c for c in rows.columns if c not in ("label", "fold", "which")]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(seen).select("features", "label").coalesce(2)
    fitted = Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=LEAF, seed=7, checkpointInterval=-1).fit(ready), names)
    fields = F.struct("which", *names)
    tried = rows.where("fold = 0").select("which", "label", fields.alias("at"))
    tenth = F.floor(fitted.score(F.col("at")) * 100).cast("int")
    table = tried.groupBy("which", tenth.alias("step")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # 100 rows a generator
    for kind in range(len(LOOSE)):
        for step in range(99, round(LEAST_SCORE * 100) - 1, -1):  # the lowest at which the precision holds
            above = [r for r in table if r["which"] == kind and r["step"] >= step]
            if above and sum(r["good"] for r in above) >= PRECISION * sum(r["n"] for r in above):
                fitted.thresholds[kind] = step / 100
    return fitted


def scan(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id and one array of spans for each kind: the base's four and the generators'."""
    trees = train(docs, most)
    text = C.text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), *[c.alias(k) for k, c in base_spans(text).items()])
    base = F.concat(*BASE)
    if trees is None:
        return rows.select("doc_id", *BASE, *[F.array().cast(S.SPAN).alias(k) for k in LOOSE])
    rows = rows.select("doc_id", *BASE, *[S.apart(c, base).alias(k) for k, c in candidates(F.col("text")).items()])
    rows = rows.select("doc_id", *BASE, _proposed({k: F.col(k) for k in LOOSE}).alias("proposed"))
    chosen = rows.select("doc_id", *BASE, F.filter("proposed", trees.selects).alias("chosen"))
    return chosen.select("doc_id", *BASE, *[_of(n).alias(k) for n, k in enumerate(LOOSE)])


def _of(n: int) -> Column:
    return F.filter("chosen", lambda c: c["which"] == n)


BASE = ("email", "ip", "card", "phone")


def report(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    base = [(k, F.col(k)) for k in BASE]
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in base]
    return scan(docs, most).select("doc_id", *counts, F.sha2(S.listed(base), 256).alias("base_sha256"), S.listed([*base, *[(k, F.col(k)) for k in LOOSE]]).alias("spans"))
