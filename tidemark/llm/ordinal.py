"""A quality classifier by ordinal cumulative-link regression.

Graded ratings share one weight for each hashed text feature and are told apart by ordered thresholds:
P(grade >= j) = sigmoid(weights . features - threshold_j), and the likelihood of a grade is the difference of two
neighbouring tails. The expected grade ranks documents, the tail probability of the best grade selects them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memory, texts, with_columns

BUCKETS = 1 << 18
#: Lengths of the beginnings of words that are features.
HEADS = (4, 5)
#: Labelled rows that are fitted at most, drawn by a hash of doc_id.
SAMPLE = 12_000
#: Words whose weights a Python worker remembers; a bound on memory only.
REMEMBERED = 250_000

_CORE = re.compile(rb"^([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)(.*?)([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)$", re.S)


def _bucket(kind: bytes, value: bytes) -> int:
    return xxhash.xxh32_intdigest(kind + value, 5) % BUCKETS


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word: its lower-case core, the core's first bytes (inflections share them), and the punctuation around it."""
    front, core, back = _CORE.match(word).groups()
    core = core.lower()
    found = [_bucket(b"w", core)] if core else []
    found += [_bucket(b"%d" % n, core[:n]) for n in HEADS if len(core) >= n]
    if front or back:
        found.append(_bucket(b"p", front + b"_" + back))
    return tuple(found)


def text_features(text: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Buckets of a text's shares of repeated, capital, numeric and marked characters, and of its length."""
    n, size = max(1, len(words)), max(1, len(text))
    same = sum(a == b for a, b in zip(words, words[1:]))
    capital = sum(text.count(c) for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digit = sum(text.count(c) for c in b"0123456789")
    marks = sum(text.count(c) for c in b"!%&$*|#<>{}=")
    level = lambda x: int(np.ceil(np.log2(x * 1024 + 1)))
    return [_bucket(k, b"%d" % v) for k, v in ((b"same", level(same / n)), (b"capital", level(capital / size)), (b"digit", level(digit / size)), (b"marks", level(marks / size)), (b"once", 10 * distinct // n), (b"length", level(len(words) / 1024)))]


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by bucket and ascending thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j from 1, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def grade(quality, toxic):
    """The rating from the two labels: 0 poor, 1 sound but toxic, 2 sound. Null where quality is null."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).otherwise(2))


def cumulative_link_gradients(tail: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of -log(P(>= grade) - P(>= grade + 1)), by the score and by each threshold; tail: P(>= j) for j from 1, by row."""
    rows, top = np.arange(len(tail)), tail.shape[1]
    whole = np.concatenate([np.ones((len(tail), 1)), tail, np.zeros((len(tail), 1))], axis=1)
    upper, lower = whole[rows, grades], whole[rows, grades + 1]
    by_cut, share = np.zeros_like(whole), np.maximum(upper - lower, 1e-12)
    by_cut[rows, grades] += upper * (1 - upper) / share
    by_cut[rows, grades + 1] -= lower * (1 - lower) / share
    return upper + lower - 1, by_cut[:, 1 : top + 1]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, top: int, epochs: int = 6, rate: float = 0.3, sparsity: float = 0.006, decay: float = 1.0, seed: int = 3) -> OrdinalModel:
    """Minimises the cumulative-link loss, -log(P(>= grade) - P(>= grade + 1)), over shuffled minibatches; thresholds stay ordered by positive gaps.

    Weights follow the regularized leader: one whose gradients add up to less than `sparsity` for each row stays zero, so
    that words which are merely rare carry no weight. Thresholds are moved by Adam.
    """
    draw = np.random.default_rng(seed)
    w, lead, square = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    cuts = np.concatenate([[-1.0], np.full(top - 1, np.log(2.0))])  # the first threshold, then logarithms of the gaps
    cm, cv = np.zeros(top), np.zeros(top)
    t, zero = 0, sparsity * len(rows)
    #: rare grades weigh more, by less than their rarity
    share = np.array([max(1, np.count_nonzero(grades == g)) for g in range(top + 1)], dtype=float) ** -0.75
    weight = share[grades] / share[grades].mean() if len(grades) else share
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for i in range(0, len(order), 64):
            at = order[i : i + 64]
            some = [rows[j] for j in at]
            flat, owner = np.concatenate(some), np.repeat(np.arange(len(at)), [len(x) for x in some])
            score = np.bincount(owner, w[flat], minlength=len(at))
            gaps = np.exp(cuts[1:])
            theta = cuts[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            tail = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60)))
            error, by_cut = cumulative_link_gradients(tail, grades[at])
            f, which = np.unique(flat, return_inverse=True)
            g = np.bincount(which, (error * weight[at])[owner])
            root = np.sqrt(square[f] + g * g)
            lead[f] += g - (root - np.sqrt(square[f])) / rate * w[f]
            square[f] += g * g
            w[f] = -np.sign(lead[f]) * np.maximum(0, np.abs(lead[f]) - zero) / ((1 + root) / rate + decay)
            gt = (by_cut * weight[at][:, None]).mean(axis=0)
            gc = np.concatenate([[gt.sum()], [gt[j:].sum() * gaps[j - 1] for j in range(1, top)]])
            t += 1
            cm += 0.1 * (gc - cm)
            cv += 0.001 * (gc * gc - cv)
            cuts = cuts - 0.02 * (cm / (1 - 0.9**t)) / (np.sqrt(cv / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(w.astype(np.float32), cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))]))


def features(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """docs with `out` (array<int>): the buckets of each whole text, repeated as often as distinct words have them."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            found = []
            for t in texts(b, text):
                words = t.split()
                distinct = set(words)
                found.append(np.array([f for w in distinct for f in word_features(w)] + text_features(t, words, len(distinct)), dtype=np.int32))
            yield [pa.array(found, pa.list_(pa.int32()))]

    return with_columns(docs, text, [T.StructField(out, T.ArrayType(T.IntegerType()), True)], fill)


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, top: int = 2) -> OrdinalModel | None:
    """Fits ratings(doc_id, grade) to the texts of docs; at most `sample` rated documents, drawn by hash, reach the driver.

    Ratings without a grade or an id are left out; of several for one document the least counts, and of several texts of
    one id the least, so no more rows than the sample are fitted. None without ratings.
    """
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    drawn = rated.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(sample)
    one = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    some = features(one).select("doc_id", "features", "grade").toArrow()
    if not some.num_rows:
        return None
    column = some["features"].combine_chunks()
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    rows = [flat[a:b] for a, b in zip(ends, ends[1:])]
    ids = some["doc_id"].to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (ids[i], len(rows[i])))
    return fit_ordinal([rows[i] for i in order], some["grade"].to_numpy()[order], top)


def rate(docs: DataFrame, model: OrdinalModel | None, text: str = "text", names: tuple[str, str, str] = ("expected_grade", "sound_prob", "tail_prob")) -> DataFrame:
    """docs with expected_grade, sound_prob (P(grade >= 1)) and tail_prob (P(best grade)), all double, or under other names.

    Null and empty texts have only the features of an empty text. Without a model all three are null. Columns of these
    names are replaced; repeated rows rate alike; an empty table gives no rows. The model is broadcast: its size is fixed.
    """
    fields = [T.StructField(n, T.DoubleType(), True) for n in names]
    if model is None:
        return docs.withColumns({f.name: F.lit(None).cast("double") for f in fields})
    shared, key = docs.sparkSession.sparkContext.broadcast(model), hash(model.weights.tobytes())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            w = shared.value.weights.astype(np.float64)
            known = memory(("ordinal", key), REMEMBERED)
            score = []
            for t in texts(b, text):
                words = t.split()
                distinct = set(words)
                for x in distinct.difference(known):
                    known[x] = float(sum(w[f] for f in word_features(x)))
                score.append(float(np.sort(np.fromiter(map(known.__getitem__, distinct), np.float64, len(distinct))).sum()) + float(sum(w[f] for f in text_features(t, words, len(distinct)))))
            tails = shared.value.tails(np.array(score, dtype=np.float64))
            yield [pa.array(x) for x in (tails.sum(axis=1), tails[:, 0], tails[:, -1])]

    return with_columns(docs, text, fields, fill)


def label_grades(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))


def select_best(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs(doc_id, text) rated by a model of the labels, with keep: is the best grade's probability at least `least`?

    Without labels nothing is rejected. Null and empty texts are rated as empty ones; repeated rows rate alike; columns of
    these names are replaced; an empty table gives no rows.
    """
    rated = rate(docs, train(docs, label_grades(labels)))
    return rated.withColumn("keep", F.coalesce(F.col("tail_prob") >= least, F.lit(True)))
