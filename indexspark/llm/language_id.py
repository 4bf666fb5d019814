"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a public tokenizer's vocabulary. The probability of a word is the
sum, over all its segmentations into pieces, of the products of the pieces' probabilities, by a forward algorithm that
handles all words of a batch at once. A text's score for a language is the sum of its words' log-probabilities; the
best language wins, and the score returned is its share among all languages.

The vocabulary is read from a file and never trained. The piece probabilities are: expectation-maximisation over the
same segmentations, on the words of a bounded sample of labelled documents outside the held-out fold (LANG_DOCS of each
language or about so many, by a hash of their ids; of their words the TRAIN_WORDS most frequent of each language).

Words are runs of letters with A-Z in lower case: all other ASCII characters separate them, and a run of more than
WORD_BYTES bytes is cut into several. A character that no piece covers costs one fixed probability in every language.

Defined cases: null, and texts without a letter, are ``und`` with score 0, as is every text if nothing could be
learned; of equal languages the first by code point wins; rows repeated are scored each; an empty table gives an empty
result; only doc_id, text and lang are read, whatever other columns there are. Texts are read whole, in batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LANG_DOCS, TRAIN_WORDS, ROUNDS = 600, 20_000, 3
WORD_BYTES = 48
#: Probability of a byte that no piece covers, and the count every piece starts with.
UNKNOWN, PRIOR = 1e-7, 0.02
#: Probabilities of beginnings are held times LIFT to the power of their bytes, so that none of a word's bytes can bring
#: them to zero or beyond the largest number: (1e-7 * LIFT)^51 to LIFT^51 for the WORD_BYTES + 3 bytes of a word.
LIFT = 1e3
_AT_ONCE = 8 << 20
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces as lower-case bytes, without control and byte pieces; a word's start is no part of them."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    made = {p.replace("▁", "").lower().encode() for p in plain}
    return sorted(p for p in made if p and all(97 <= b <= 122 or b >= 128 for b in p))


class Lookup:
    """Piece numbers of byte runs: a table of all beginnings of pieces, probed by a 64-bit hash of the bytes."""

    BITS = 21

    def __init__(self, vocabulary: list[bytes]):
        self.size, self.longest = len(vocabulary), max(map(len, vocabulary), default=1)
        number = {p[:n]: self.size for p in vocabulary for n in range(1, len(p))} | {p: i for i, p in enumerate(vocabulary)}
        runs = sorted(number)
        rows = np.frombuffer(b"".join(r.ljust(self.longest, b"\0") for r in runs), np.uint8).reshape(-1, self.longest).astype(np.uint64)
        length, keys = np.array([len(r) for r in runs]), np.zeros(len(runs), np.uint64)
        for n in range(1, self.longest + 1):
            longer = length >= n
            keys[longer] = self.grow(keys[longer], rows[longer, n - 1])
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two runs have one 64-bit hash")
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([number[r] for r in runs], np.int32)[order]
        slot = (self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << self.BITS) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.first).max(initial=0))

    @staticmethod
    def grow(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = (key + byte + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return key ^ (key >> np.uint64(29))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece numbers; the vocabulary's size for mere beginnings of pieces, -1 for all else."""
        slot = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(key), -1, np.int32)
        for _ in range(self.deep):
            open_ = np.flatnonzero(at < end)
            if not len(open_):
                break
            hit = self.keys[at[open_]] == key[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            at[open_] += 1
        return out


def _matrix(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, and their lengths."""
    words = words.cast(pa.binary())
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    length = np.diff(offsets)
    wide = int(length.max(initial=1))
    at = offsets[:-1, None] + np.arange(wide)
    rows = data[np.minimum(at, len(data) - 1)]
    return np.where(np.arange(wide) < length[:, None], rows, 0).astype(np.uint8), length


@dataclass
class Segments:
    """All places where a piece stands in a batch of words: by end, (rows, begin, piece)."""

    by_end: list[list[tuple[np.ndarray, int, np.ndarray]]]
    length: np.ndarray


def segments(words: pa.Array, lookup: Lookup) -> Segments:
    rows, length = _matrix(words)
    wide = rows.shape[1]
    by_end: list[list] = [[] for _ in range(wide + 1)]
    bytes64 = rows.astype(np.uint64)
    for begin in range(wide):
        row = np.flatnonzero(length > begin)
        key = np.zeros(len(row), np.uint64)
        for end in range(begin + 1, min(begin + lookup.longest, wide) + 1):
            inside = length[row] >= end
            row, key = row[inside], lookup.grow(key[inside], bytes64[row[inside], end - 1])
            piece = lookup.find(key)
            known = piece >= 0  # no piece begins like the others
            row, key, piece = row[known], key[known], piece[known]
            if not len(row):
                break
            whole = piece < lookup.size
            by_end[end].append((row[whole], begin, piece[whole]))
    return Segments(by_end, length)


def forward(found: Segments, p: np.ndarray) -> np.ndarray:
    """Probabilities of all beginnings of the words, times LIFT to the power of their bytes: (words, ends, languages).

    ``p``: (pieces, languages). A byte that no piece covers is passed at the fixed probability.
    """
    n, wide, langs = len(found.length), len(found.by_end) - 1, p.shape[1]
    a = np.zeros((n, wide + 1, langs))
    a[:, 0] = 1
    for end in range(1, wide + 1):
        a[:, end] = a[:, end - 1] * (UNKNOWN * LIFT)
        for rows, begin, piece in found.by_end[end]:
            a[rows, end] += a[rows, begin] * (p[piece] * LIFT ** (end - begin))
    return a


def word_scores(words: pa.Array, lookup: Lookup, p: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    length = pc.binary_length(words).to_numpy(zero_copy_only=False)
    for low, high in ((1, 4), (5, 8), (9, 12), (13, 16), (17, 24), (25, WORD_BYTES + 8)):
        some = np.flatnonzero((length >= low) & (length <= high))
        for at in range(0, len(some), 20_000):
            part = some[at : at + 20_000]
            found = segments(words.take(pa.array(part)), lookup)
            a = forward(found, p)
            out[part] = np.log(a[np.arange(len(part)), found.length]) - np.log(LIFT) * found.length[:, None]
    return out


def expected(words: pa.Array, counts: np.ndarray, lookup: Lookup, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all segmentations of the counted words; ``p``: (pieces, 1)."""
    use = np.zeros(lookup.size)
    for at in range(0, len(words), 20_000):
        found = segments(words.slice(at, 20_000), lookup)
        n = counts[at : at + 20_000]
        a = forward(found, p)[:, :, 0]
        wide, rows = a.shape[1] - 1, np.arange(len(n))
        b = np.zeros_like(a)
        b[rows, found.length] = 1
        for end in range(wide, 0, -1):
            b[:, end - 1] += b[:, end] * (UNKNOWN * LIFT)
            for r, begin, piece in found.by_end[end]:
                b[r, begin] += b[r, end] * (p[piece, 0] * LIFT ** (end - begin))
        whole = n / a[rows, found.length]
        for end in range(1, wide + 1):
            for r, begin, piece in found.by_end[end]:
                np.add.at(use, piece, a[r, begin] * (p[piece, 0] * LIFT ** (end - begin)) * b[r, end] * whole[r])
    return use


def _cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts and the number of words of each text."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])  # offsets from zero
    data = (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes().translate(_TO_WORDS)
    plain = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, texts.buffers()[1], pa.py_buffer(data)])
    split = pc.ascii_split_whitespace(plain.cast(pa.large_string()))
    flat, n = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat_n = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    if flat_n.max(initial=0) > WORD_BYTES:
        owner = np.repeat(np.arange(len(n)), n)
        parts = [_parts(w) if len(w) > WORD_BYTES else [w] for w in flat.cast(pa.large_binary()).to_pylist()]
        many = np.array([len(x) for x in parts])
        flat = pa.array([w for x in parts for w in x], pa.large_binary()).cast(pa.large_string())
        n = np.bincount(np.repeat(owner, many), minlength=len(n))
    else:
        owner = np.repeat(np.arange(len(n)), n)
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not keep.all():  # blanks at a text's ends leave empty words
        owner = np.repeat(np.arange(len(n)), n)[keep]
        flat, n = flat.filter(pa.array(keep)), np.bincount(owner, minlength=len(n))
    return flat, n


def _parts(word: bytes) -> list[bytes]:
    """A long run in parts of WORD_BYTES bytes, cut between characters."""
    out, at = [], 0
    while at < len(word):
        end = min(at + WORD_BYTES, len(word))
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end += 1
        out.append(word[at:end])
        at = end
    return out


@dataclass
class Model:
    langs: list[str]
    vocabulary: list[bytes]
    p: np.ndarray

    def totals(self, texts: pa.Array, cache: dict) -> np.ndarray:
        """Log-probability of each text in each language."""
        lookup = cache.get("lookup") or cache.setdefault("lookup", Lookup(self.vocabulary))
        out = np.zeros((len(texts), len(self.langs)))
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // _AT_ONCE
        begin = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(texts)]
        for i, j in zip(begin[:-1], begin[1:], strict=True):
            words, n = _cut_words(texts.slice(i, j - i))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            score, at = word_scores(coded.dictionary, lookup, self.p), coded.indices.to_numpy(zero_copy_only=False)
            full = np.flatnonzero(n)
            first = np.r_[0, np.cumsum(n[full])[:-1]]
            for k in range(len(self.langs)):
                out[i + full, k] = np.add.reduceat(score[at, k], first)
        return out


def train(docs: DataFrame, path: str = VOCABULARY, most: int = LANG_DOCS) -> Model | None:
    """Piece probabilities of each language among the documents outside the held-out fold."""
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(~C.held_out())
    least = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in least.collect()}  # one row a language
    if not sizes:
        return None
    # a language's share of the hash range that holds about `most` of its documents
    share = [F.struct(F.lit(k).alias("k"), F.lit(min(1.0, most / n)).alias("v")) for k, n in sizes.items()]
    wanted = F.element_at(F.map_from_entries(F.array(*share)), F.col("lang"))
    chosen = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0) < wanted)
    word = F.explode(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x00-\\x60\\x7B-\\x7F]+")).alias("word")
    counted = chosen.select("lang", word).where(F.octet_length("word").between(1, WORD_BYTES)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = C.materialize(counted, "language-words")
    vocabulary = pieces(path)
    lookup = Lookup(vocabulary)
    langs, columns = sorted(sizes), []
    for lang in langs:
        top = counted.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(TRAIN_WORDS).select("word", "n").collect()
        words, n = pa.array([r["word"] for r in top], pa.large_string()), np.array([r["n"] for r in top], float)
        p = np.full((lookup.size, 1), 1.0 / lookup.size)
        for _ in range(ROUNDS if len(top) else 0):
            use = expected(words, n, lookup, p) + PRIOR
            p = (use / use.sum())[:, None]
        columns.append(p)
    return Model(langs, vocabulary, np.hstack(columns))


RESULT = "struct<lang_pred:string,score:double>"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    base = docs.select("doc_id", C.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    if model is None:
        return base.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    cache: dict = {}

    @F.arrow_udf(RESULT)
    def best(texts: pa.Array) -> pa.Array:
        t = model.totals(texts, cache)
        top = t.argmax(axis=1)
        share = 1 / np.exp(np.maximum(t - t.max(axis=1, keepdims=True), -700)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array([model.langs[k] for k in top], pa.string()), pa.array(share, pa.float64())], ["lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    judged = base.select("doc_id", "held_out", letters.alias("letters"), best("text").alias("r"))
    return judged.select("doc_id", "held_out", F.when(F.col("letters"), F.col("r.lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("r.score")).otherwise(0.0).alias("score"))


def report(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return predict(docs, train(docs, path))
