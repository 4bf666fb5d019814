"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks, trained on labelled sentences.

A text is read as segments: white space splits, case is folded, punctuation inside a segment is dropped, a few digits
are read as the letters they stand for, and single letters set apart from each other are joined, so ``i d i o t`` and
``id-iot`` are segments like any other. The kernel of two segments sums, over all subsequences of three characters
(the ends of a segment count as characters) with up to one skipped character between neighbours, the products of their
weights; each skipped character costs a factor. Inserted and gapped characters so lower the kernel but keep it high.

Letters set apart are also read in windows of WINDOWS letters, so ordinary one-letter words beside them hide nothing.

The labels mark documents, not segments. Of near copies among the training documents one is read. Whole segments and
segment starts and ends (STEMS characters) that are significantly more frequent in toxic training documents are signs;
the segments of toxic documents that bear a sign are the witnesses, each sign's most frequent first. Witnesses and
segments of other training documents form the training sentences of a multiple-instance SVM; landmarks are the first
witnesses and the segments most like them; Nyström features of the landmarks carry a linear SVM, refitted FITS times with
its hardest negatives and with the first witnesses' forms that have a letter inserted. As the kernel has an explicit feature space, the machine is one weight per subsequence, and a
text's score is the largest segment score, calibrated by a logistic fit on training documents.

Training uses a bounded sample of the labelled rows outside the held-out fold: TRAIN_DOCS documents of each class, those
with the smallest hash of their ids. Scoring reads all of every text, in bounded pieces cut between segments.

Defined cases: null and empty texts score as low as a text can; repeated rows get equal scores; without toxic labels
(or any) every score is 0; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bounds of the training sample: documents of each class, distinct segments of other documents, landmarks.
TRAIN_DOCS, TRAIN_SEGMENTS, LANDMARKS = 3000, 150_000, 600
#: Hard negatives that join at each of the fits; twice as many are kept.
HARD_NEGATIVES, FITS = 3000, 6
#: Most signs and witnesses; lengths of segment starts and ends that can be signs.
SIGNS, WITNESSES, STEMS = 3000, 2000, (4, 5, 6)
#: Near copies in the training sample: words of a shingle, bands of row hashes (4 in 5 equal shingles: found 199 in 200).
COPY_SHINGLE, COPY_BANDS, COPY_ROWS = 5, 10, 4
#: Lengths of the windows over letters set apart.
WINDOWS = range(4, 11)
SKIP = np.float32(0.6)
#: Twice the log-likelihood ratio from which a segment's excess in toxic documents counts.
SIGNIFICANT = 15.0
#: Least share of toxic ones among the training documents that hold a sign or a witness.
PURE = 0.75
#: Least share of the toxic training documents that hold a sign; passages that a few of them share are none.
SHARE = 0.02
LOWEST = -2.0
_SIZE = 28
_STEPS = ((1, 2, 0), (1, 3, 1), (2, 3, 1), (2, 4, 2))
_END = 29
_PIECE = 1 << 18
_DIGITS = {ord("0"): "o", ord("1"): "i", ord("3"): "e", ord("4"): "a", ord("5"): "s", ord("7"): "t"}


def _code(byte: int) -> int:
    letter = _DIGITS.get(byte, chr(byte).lower() if byte < 128 else "~")
    return 27 if letter == "~" and byte >= 128 else ord(letter) - 96 if "a" <= letter <= "z" else 0


_CODES = bytes(map(_code, range(256)))
_APART = re.compile(rb"(?<![^\0])[^\0](?:\0+[^\0](?![^\0])){3,}")
_DROPPED = bytes(b for b in range(128) if not _CODES[b] and b not in b" \t\n\r\x0b\x0c")


def _pieces(text: bytes) -> list[bytes]:
    """The text as segment codes, 0 between segments, in pieces of bounded length."""
    coded = text.translate(_CODES, _DROPPED)
    out, at = [], 0
    while len(coded) - at > _PIECE:
        end = coded.rfind(b"\0", at, at + _PIECE)
        end = at + _PIECE if end <= at else end
        out.append(coded[at:end])
        at = end
    return [*out, coded[at:]]


def _windows(coded: bytes) -> Iterator[bytes]:
    """Windows over each run of four or more letters set apart, as segments, in pieces of bounded length."""
    out, size = [], 0
    for run in _APART.finditer(coded):
        letters = run.group().replace(b"\0", b"")
        for at in range(len(letters) - WINDOWS[0] + 1):
            for n in WINDOWS:
                if n < len(letters) and at + n <= len(letters):
                    out.append(letters[at : at + n])
                    size += n + 1
            if size >= _PIECE:
                yield b"\0".join(out)
                out, size = [], 0
    if out:
        yield b"\0".join(out)


def _segments(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with single zeros round the segments, the zeros' places, and the text number of each segment."""
    a = np.frombuffer(b"\0" + bytes([_END]).join(coded) + b"\0\0", np.uint8).copy()
    ends = a == _END
    a[ends] = 0
    number = np.cumsum(ends, dtype=np.int32)
    zero = a == 0
    keep = np.ones(len(a), bool)
    keep[1:] = ~(zero[1:] & zero[:-1])
    a, number, zero = a[keep], number[keep], zero[keep]
    at = np.flatnonzero(zero)
    if len(at) > 2:  # a zero between two single letters of one text
        single = np.diff(at) == 2
        between = at[1:-1][single[:-1] & single[1:] & (number[at[1:-1] - 1] == number[at[1:-1] + 1])]
        keep = np.ones(len(a), bool)
        keep[between] = False
        a, number = a[keep], number[keep]
        at = np.flatnonzero(a == 0)
    return a, at, number[at[:-1] + 1] if len(at) > 1 else np.zeros(0, np.int32)


def _occurrences(a: np.ndarray):
    """(first place, feature, weight) of every subsequence of three characters, by kind of gap."""
    v, inner = a.astype(np.int32), a != 0
    for one, two, skipped in _STEPS:
        n = len(a) - two
        if n <= 0:
            continue
        ok = inner[1 : n + 1].copy()
        for k in range(2, two):
            ok &= inner[k : n + k]
        first = np.flatnonzero(ok)
        yield first, (v[first] * _SIZE + v[first + one]) * _SIZE + v[first + two], SKIP**skipped


def _norm(length: np.ndarray) -> np.ndarray:
    """The kernel's normaliser of a segment with this many characters, both ends counted."""
    n = np.maximum(length[..., None] - np.array([2, 3, 3, 4]), 0)
    return np.sqrt(n @ np.array([1, SKIP**2, SKIP**2, SKIP**4]) + 1e-9)


def _features(segments: list[bytes]) -> np.ndarray:
    """Normalised feature rows of a bounded list of segments."""
    out = np.zeros((len(segments), _SIZE**3), np.float32)
    for i, s in enumerate(segments):
        a = np.frombuffer(b"\0" + s + b"\0", np.uint8)
        for _, feature, weight in _occurrences(a):
            np.add.at(out[i], feature, weight)
        out[i] /= _norm(np.array(len(a)))
    return out


def _svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and balanced classes, by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = np.float32(1.0 / (2 * np.linalg.eigvalsh(((x1 * c[:, None]).T @ x1).astype(np.float64))[-1] + strength))
    w = last = np.zeros(x1.shape[1], np.float32)
    for t in range(steps):
        z = w + np.float32(t / (t + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x1 @ z))
        last, w = w, z - rate * (np.float32(strength) * z - 2 * x1.T @ (c * y * slack))
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Machine:
    """One weight per subsequence, the offset, and the calibration."""

    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        """The largest segment margin of each text."""
        out = np.full(len(texts), LOWEST, np.float64)
        pieces, owner, size = [], [], 0
        for i, t in enumerate(texts):
            for p in _pieces(t) if t else ():
                for part in chain((p,), _windows(p)):
                    pieces.append(part)
                    owner.append(i)
                    size += len(part)
                    if size >= 2 * _PIECE:
                        self._raise(out, pieces, np.array(owner))
                        pieces, owner, size = [], [], 0
            if size >= _PIECE or i == len(texts) - 1:
                if pieces:
                    self._raise(out, pieces, np.array(owner))
                pieces, owner, size = [], [], 0
        return out

    def _raise(self, out: np.ndarray, pieces: list[bytes], owner: np.ndarray) -> None:
        a, at, number = _segments(pieces)
        if not len(number):
            return
        score = np.zeros(len(a), np.float32)
        for first, feature, weight in _occurrences(a):
            score[first] += self.weights[feature] * weight
        margin = np.add.reduceat(score, at[:-1]) / _norm(np.diff(at) + 1) + self.offset
        starts = np.flatnonzero(np.r_[True, np.diff(number) > 0])
        np.maximum.at(out, owner[number[starts]], np.maximum.reduceat(margin, starts))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(self.margins(texts), LOWEST) + self.shift, -30, 30)))


def _kernel(segments: list[bytes], marks: np.ndarray) -> np.ndarray:
    """Kernel values of a bounded list of segments with the rows ``marks``, some feature rows at a time."""
    return np.vstack([_features(segments[at : at + 256]) @ marks.T for at in range(0, len(segments), 256)])


def _inserted(s: bytes) -> list[bytes]:
    """``s`` with one letter inserted, once at each inner place."""
    return [s[:i] + bytes([1 + (7 * i + s[0]) % 26]) + s[i:] for i in range(1, len(s))]


def _fit(witnesses: list[bytes], others: list[bytes]) -> Machine:
    """SVM on Nyström features; the hardest negatives among all ``others`` join the next fit."""
    first = witnesses[: LANDMARKS // 2]
    top = _features(first)
    rough = sorted({v for s in first for v in _inserted(s)}.difference(witnesses, others))
    sign = np.ones(len(witnesses) + len(rough), np.float32)
    pick = others[:HARD_NEGATIVES]
    for _ in range(FITS):
        like = np.argsort(-_kernel(pick, top).max(axis=1), kind="stable")[: LANDMARKS - len(top)]
        marks = np.vstack([top, _features([pick[i] for i in like])])
        value, vector = np.linalg.eigh(marks @ marks.T)
        good = value > 1e-3 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])
        x = _kernel([*witnesses, *rough, *pick], marks) @ root
        w, offset = _svm(x, np.r_[sign, -np.ones(len(pick), np.float32)])
        machine = Machine((marks.T @ (root @ w)).astype(np.float32), offset)
        hard = [others[i] for i in np.argsort(-machine.margins(others), kind="stable")[:HARD_NEGATIVES]]
        pick = list(dict.fromkeys([*hard, *pick]))[: 2 * HARD_NEGATIVES]
    return machine


def _calibrated(machine: Machine, x: np.ndarray, labels: np.ndarray) -> Machine:
    """Logistic fit of the labels on the margins, with smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = 1.0 / max(len(x), 1)
    p = np.zeros(2)
    x1 = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x1 @ p, -30, 30)))
        h = (x1 * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x1 + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x1.T @ (weight * (q - target)) + 1e-6 * p)
        p = p - np.clip(step, -2, 2)
    return Machine(machine.weights, machine.offset, float(max(p[0], 1e-3)), float(p[1]))


def _distinct(text: bytes) -> list[bytes]:
    """The distinct segments of a text, as codes."""
    found: set[bytes] = set()
    for piece in _pieces(text):
        a, _, _ = _segments([piece])
        found.update(a.tobytes().split(b"\0"))
    return sorted(s for s in found if s and len(s) <= 64)  # longer runs are no training sentences


def _bands(text: bytes) -> list[int]:
    """Band hashes of the minimum shingle hashes; near copies share one. Hashes are taken in bounded pieces."""
    w = text.lower().split()
    least = np.full(COPY_BANDS * COPY_ROWS, np.iinfo(np.uint64).max, np.uint64)
    odd, last = np.random.default_rng(7).integers(1, 1 << 63, (2, len(least)), np.uint64) | np.uint64(1)
    for at in range(0, max(1, len(w) - COPY_SHINGLE + 1), 4096):
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + COPY_SHINGLE])) for i in range(at, min(at + 4096, max(1, len(w) - COPY_SHINGLE + 1)))]
        mixed = np.array(h, np.uint64)[:, None] * odd
        mixed = (mixed ^ (mixed >> np.uint64(31))) * last
        least = np.minimum(least, mixed.min(axis=0))
    return [xxhash.xxh64_intdigest(bytes([i]) + row.tobytes()) >> 1 for i, row in enumerate(least.reshape(COPY_BANDS, COPY_ROWS))]


def _of_each_copy(rows: list[tuple[int, int, list[int]]]) -> list[tuple[int, int]]:
    """(toxic, doc_id) of the first document of each group that shares bands; ``rows`` are the sample's, so bounded."""
    first: dict[int, int] = {}
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, (toxic, _, bands) in enumerate(rows):
        for band in bands:
            j = top(first.setdefault(2 * band + toxic, i))
            root[max(j, top(i))] = min(j, top(i))
    return [(toxic, doc) for i, (toxic, doc, _) in enumerate(rows) if top(i) == i]


def _in_turn(found: list[tuple[bytes, bytes, int]]) -> list[bytes]:
    """Witnesses from (segment, sign, count): the most frequent of each sign, then the second of each, and so on."""
    rank: dict[bytes, int] = {}
    turn = []
    for s, sign, n in sorted(found, key=lambda f: (-f[2], f[0])):
        rank[sign] = rank.get(sign, 0) + 1
        turn.append((rank[sign], -n, s))
    return [s for _, _, s in sorted(turn)][:WITNESSES]


def _margin_udf(machine: Machine):
    @F.arrow_udf("double")
    def margin(texts: pa.Array) -> pa.Array:
        return pa.array(machine.margins(texts.cast(pa.binary()).to_pylist()), pa.float64())

    return margin


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Machine | None:
    """Learn from ``labels.toxic`` outside the held-out fold; None where one class is missing."""
    known = labels.where("toxic is not null and doc_id is not null").where(~C.held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = [known.where(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    chosen = C.materialize(ranked[0].unionAll(ranked[1]), "toxic-sample")  # 2 * most rows at the most
    sample = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    sample = C.materialize(sample.join(F.broadcast(chosen.select("doc_id", F.col("toxic").cast("int").alias("toxic"))), "doc_id"), "toxic-texts")

    @F.arrow_udf("array<binary>")
    def segments(texts: pa.Array) -> pa.Array:
        return pa.array([_distinct(t) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.binary()))

    @F.arrow_udf("array<bigint>")
    def bands(texts: pa.Array) -> pa.Array:
        return pa.array([_bands(t) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    # one row of bands for each document of the bounded sample reaches the driver
    marked = sample.select(F.col("toxic"), F.col("doc_id").cast("long").alias("doc_id"), bands("text").alias("bands")).distinct().collect()
    alone = _of_each_copy(sorted((r["toxic"], r["doc_id"], r["bands"]) for r in marked))
    n1, n0 = float(sum(t for t, _ in alone)), float(sum(1 - t for t, _ in alone))
    if not n1 or not n0:
        return None
    alone = docs.sparkSession.createDataFrame(alone, "toxic int, doc_id bigint")
    each = sample.join(F.broadcast(alone), ["doc_id", "toxic"], "left_semi").select("doc_id", "toxic", F.explode(segments("text")).alias("s"))
    each = C.materialize(each.distinct(), "toxic-segments")
    counted = C.materialize(each.groupBy("s").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0")), "toxic-counts")
    k1, k0 = F.col("k1"), F.col("k0")
    all_ = (k1 + k0) / F.lit(n1 + n0)
    g = 2 * (k1 * F.log(k1 / (all_ * n1)) + F.coalesce(k0 * F.log(F.when(k0 > 0, k0 / (all_ * n0))), F.lit(0.0)))
    more = (k1 / n1 > 4 * k0 / n0) & (k1 >= PURE * (k1 + k0))
    end, length = F.lit(b"\0"), F.length("s")
    parts = [F.when(length > 2, F.concat(end, F.col("s"), end))]
    parts += [F.when(length > n, F.concat(end, F.substring("s", 1, n))) for n in STEMS]
    parts += [F.when(length > n, F.concat(F.substring("s", -n, n), end)) for n in STEMS]
    signed = each.select("doc_id", "toxic", "s", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("sign"))
    signs = signed.groupBy("sign").agg(
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("k1"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("k0")
    )
    signs = signs.where(k1 >= F.lit(max(1.0, SHARE * n1))).withColumn("g", g).where((F.col("g") >= SIGNIFICANT) & more)
    signs = C.materialize(signs.orderBy(F.desc("g"), "sign").limit(SIGNS).select("sign", "g"), "toxic-signs")
    borne = signed.where("toxic = 1").join(F.broadcast(signs), "sign").groupBy("s").agg(F.max(F.struct("g", "sign")).alias("best"))
    borne = borne.join(counted, "s").where(more).select("s", "best.sign", "k1").orderBy(F.desc("k1"), "s").limit(4 * WITNESSES)
    witnesses = _in_turn([(bytes(r["s"]), bytes(r["sign"]), r["k1"]) for r in borne.collect()])
    ordinary = counted.where("k0 > 0").where(~more).orderBy(F.xxhash64("s"), "s").select("s").limit(TRAIN_SEGMENTS)
    others = [bytes(r["s"]) for r in ordinary.collect()]
    if not witnesses or not others:
        return None
    machine = _fit(witnesses, others)
    # the calibration reads margins only: one number for each of the sampled documents reaches the driver
    margins = sample.select("toxic", _margin_udf(machine)("text").alias("m")).collect()
    return _calibrated(machine, np.array([r["m"] for r in margins]), np.array([float(r["toxic"]) for r in margins]))


def score_column(machine: Machine | None, text: str = "text"):
    """The score of ``text`` as a column; 0 without a machine."""
    if machine is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(machine.scores(texts.cast(pa.binary()).to_pylist()), pa.float64())

    return score(F.col(text).cast("string"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = docs.select("doc_id", C.held_out().alias("held_out"), score_column(train(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score as toxic."""
    name = "__toxic_score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, score_column(train(docs, labels))).where(F.col(name) < 0.5).drop(name)
