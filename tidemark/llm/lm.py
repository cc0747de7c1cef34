"""Language-model scores from a small causal self-attention model on subword ids.

The model has one place for each subword id, and one for the text's end. It reads all ids before a place, attends over
them, and predicts the place's id: by a softmax over classes of ids, and the id's share of its class. Ids that begin words
and ids inside them are in different classes, so the model also says whether a word is over. A word's first id has its
probability from the attention; the rest of the word, given the first id, from a mixture of the attention over its ids up
to the word's end, and of the counts of all training words, whose remainder for other words is spelled by pairs of
subwords. So the probabilities of all words and the end add up to one at most, and a text's score is a log probability.

Counts, classes and weights come from the whole texts of all training documents, by shuffles and by rounds of distributed
training whose results are averaged. A text is scored in overlapping windows; every place counts once, in the window in
which most context precedes it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, texts, with_columns, written
from .hyperdim import fold

CLASSES, SINGLE, WIDTH = 96, 48, 16
WINDOW, OVERLAP = 64, 8
#: Length of the vectors by which ids are put into classes, and the places on either side that count as near.
NEAR, SIDE = 8, 8
#: Classes of ids by which the next id of a word is spelled, how many counts the shares over all of them weigh, and the length of the vectors that put ids into them.
SPELLINGS, PRIOR, FOLLOW = 128, 50, 16
#: The part of the ids' plain shares in the mixture with the model's.
SHARE = 0.05
#: The part of the attention in the mixture for what follows a word's first id.
MIX = 0.3
#: Hashed parts of the training documents that the rounds of training end at; the last round has most.
ROUNDS, PARTS = (2, 12, 100), 100
#: Places that all tasks together descend on at least, by as many passes over their texts as that takes, and places of a task at least.
LEAST_PLACES, TASK_PLACES = 1_500_000, 1_000_000
#: Bytes of text in a group of documents that share a dictionary; the groups follow the input. Words whose ids are gathered at a time.
GROUP_BYTES, WORDS_AT_ONCE = 24 << 20, 200_000
#: Buckets of words for each partition of the input.
BUCKETS = 4


class Subwords:
    """Words' subword ids. The id after the vocabulary's last is the end of a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encode = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1

    def ids(self, word: bytes) -> list[int]:
        return self.encode(" " + word.decode("utf-8", "replace"))


_subwords: dict[int, Subwords] = {}


def subwords(tokenizer: tuple[dict[bytes, int], str]) -> Subwords:
    key = hash((len(tokenizer[0]), frozenset(tokenizer[0]), tokenizer[1]))
    if key not in _subwords:
        _subwords.clear()
        _subwords[key] = Subwords(*tokenizer)
    return _subwords[key]


#: One where a place may attend to another.
_BEHIND = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))
#: Exponents of float32 below this need no shift.
_SAFE = 60
DENSE = ("P", "A", "O", "U", "c")


def start_weights(size: int, share: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Random embeddings of `size` ids, and no say of the context yet: the classes' shares alone."""
    draw, d = np.random.default_rng(seed), WIDTH
    make = lambda *s, by=1.0: (draw.standard_normal(s) * by).astype(np.float32)
    return {"E": make(size, d), "P": make(WINDOW, d, by=0.1), "A": make(d, 3 * d, by=d**-0.5), "O": make(d, d, by=d**-0.5), "U": np.zeros((d, CLASSES), np.float32), "c": np.log(share).astype(np.float32)}


def attend(w: dict[str, np.ndarray], x: np.ndarray) -> tuple:
    """Windows of ids (rows of x, of one length): each place's sum of embeddings; its query, key, value and a one; how it attends to each place, not yet divided by the sum; and, a row for each place, this sum, what is attended to, and what the place knows of those so far, with a one."""
    (many, t), d, kind = x.shape, WIDTH, w["A"].dtype
    e = w["E"][x]
    e += w["P"][:t]
    qkv = np.ones((x.size, 3 * d + 1), dtype=kind)
    np.matmul(e.reshape(-1, d), scaled(w), out=qkv[:, : 3 * d])
    qkv = qkv.reshape(many, t, 3 * d + 1)
    s = qkv[:, :, :d] @ qkv[:, :, d : 2 * d].transpose(0, 2, 1)
    if s.max(initial=0) > _SAFE or s.min(initial=0) < -_SAFE:
        s -= np.where(_BEHIND[:t, :t] > 0, s, -np.inf).max(axis=2, keepdims=True)
        np.minimum(s, 0, out=s)
    np.exp(s, out=s)
    s *= _BEHIND[:t, :t]
    av = (s @ qkv[:, :, 2 * d :]).reshape(-1, d + 1)
    total = av[:, d:]
    av = av[:, :d] / total
    h = np.ones((x.size, d + 1), dtype=kind)
    np.add(e.reshape(-1, d), av @ w["O"], out=h[:, :d])
    return e, qkv, s, total, av, h


def scaled(w: dict[str, np.ndarray]) -> np.ndarray:
    """The weights of queries, keys and values, with the scale of the products in the queries."""
    return w["A"] * np.repeat(np.array([WIDTH**-0.5, 1, 1], dtype=w["A"].dtype), WIDTH)


def with_bias(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w["U"], w["c"][None, :]])


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """The mean negative log likelihood of classes y where `use` is set, its gradients by the dense weights, and by each place's embedding."""
    e, qkv, s, sums, av, h = attend(w, x)
    (many, t), d = x.shape, WIDTH
    flat, on = y.reshape(-1), use.reshape(-1)
    n = np.float32(max(1, np.count_nonzero(on)))
    p = h @ with_bias(w)
    if p.max(initial=0) > _SAFE:
        p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    own, total = np.arange(len(flat)), p @ np.ones(p.shape[1], dtype=p.dtype)
    loss = -float((np.log(p[own, flat] / total) * on).sum()) / float(n)
    each = (on / n).astype(np.float32)
    p *= (each / total)[:, None]
    p[own, flat] -= each
    gu = h.T @ p
    g = {"U": gu[:d], "c": gu[d]}
    dh = p @ w["U"].T
    g["O"] = av.T @ dh
    dav = dh @ w["O"].T
    # by the weights before their division: the last column takes off what all weights of a place share
    back = np.empty((len(dav), d + 1), dtype=dav.dtype)
    np.divide(dav, sums, out=back[:, :d])
    np.divide(np.einsum("ij,ij->i", dav, av), -sums[:, 0], out=back[:, d])
    back, dqkv = back.reshape(many, t, d + 1), np.empty((many, t, 3 * d), dtype=dav.dtype)
    ds = back @ qkv[:, :, 2 * d :].transpose(0, 2, 1)
    ds *= s
    np.matmul(ds, qkv[:, :, d : 2 * d], out=dqkv[:, :, :d])
    np.matmul(ds.transpose(0, 2, 1), qkv[:, :, :d], out=dqkv[:, :, d : 2 * d])
    np.matmul(s.transpose(0, 2, 1), back[:, :, :d], out=dqkv[:, :, 2 * d :])
    by = dqkv.reshape(-1, 3 * d)
    g["A"] = e.reshape(-1, d).T @ by
    g["A"][:, :d] *= d**-0.5
    dh += by @ scaled(w).T
    g["P"] = np.zeros_like(w["P"])
    g["P"][:t] = dh.reshape(many, t, d).sum(axis=0)
    return loss, g, dh


class Descent:
    """Weights on their way down: Adam for the dense ones, one step size a row for the embeddings."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in w.items()}
        self.m, self.s = ({k: np.zeros_like(w[k]) for k in DENSE} for _ in range(2))
        self.square = np.full(len(w["E"]), 1e-8, dtype=np.float32)
        self.seen = np.zeros(len(w["E"]), dtype=np.int64)
        self.t = 0

    def step(self, x: np.ndarray, y: np.ndarray, use: np.ndarray, rate: float = 0.02) -> float:
        loss, g, de = gradients(self.w, x, y, use)
        self.t += 1
        rate, m, s, t = rate / (1 + self.t / 200) ** 0.5, self.m, self.s, self.t
        for k in DENSE:
            m[k] += np.float32(0.1) * (g[k] - m[k])
            s[k] += np.float32(0.01) * (g[k] * g[k] - s[k])
            self.w[k] -= np.float32(rate / (1 - 0.9**t)) * m[k] / (np.sqrt(s[k] / np.float32(1 - 0.99**t)) + np.float32(1e-8))
        self._rows(x.reshape(-1), de, np.float32(3 * rate))
        return loss

    def _rows(self, ids: np.ndarray, de: np.ndarray, rate: np.float32) -> None:
        if len(self.seen) <= 1 << 16:  # short numbers are sorted by radix
            ids = ids.astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        own = ids[order]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        at, g = own[start], np.add.reduceat(de[order], start, axis=0)
        self.seen[at] += np.diff(start, append=len(own))
        self.square[at] += (g * g).mean(axis=1)
        self.w["E"][at] -= rate * g / np.sqrt(self.square[at])[:, None]


def training_windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows side by side over concatenated texts of these sizes: the place of each one's first target, and its text's end."""
    many = -(-sizes // WINDOW)
    owner, end = np.repeat(np.arange(len(sizes)), many), np.cumsum(sizes)
    begin = (end - sizes)[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    return begin, end[owner]


def again(rows: Iterable, passes: int) -> Iterator:
    """rows, as many times over as there are passes; they are held where there are several."""
    held = []
    for r in rows:
        if passes > 1:
            held.append(r)
        yield r
    for _ in range(passes - 1):
        yield from held


def train_on_stream(w: dict[str, np.ndarray], rows: Iterable[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, batch: int = 64, seed: int = 2, passes: int = 1) -> tuple[Descent, int]:
    """Descends on all places of (ids of concatenated texts, their sizes), windows shuffled within each; also how many places.

    Only one element is held at a time where there is one pass, so texts and input may be of any size.
    """
    down, draw, seen = Descent(w), np.random.default_rng(seed), 0
    for ids, sizes in again(rows, passes):
        begin, end = training_windows(sizes)
        before, y = shifted(ids, sizes), classes[ids]
        seen += len(ids)
        order = draw.permutation(len(begin))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            place = begin[at][:, None] + np.arange(WINDOW)
            use = place < end[at][:, None]
            place = np.minimum(place, end[at][:, None] - 1)
            down.step(before[place], y[place], use)
    return down, seen


def shifted(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What each place reads: the id before; a text begins after an end. Every text ends with the end's id."""
    x = np.empty_like(ids)
    x[1:] = ids[:-1]
    if len(ids):
        x[(np.cumsum(sizes) - sizes)[sizes > 0]] = ids[-1]
    return x


def window_table(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over concatenated texts of these sizes: places (rows), and whether each place is scored.

    A later window begins OVERLAP places before what it scores; places after a text's end repeat its last.
    """
    step = WINDOW - OVERLAP
    many = np.where(sizes > WINDOW, 1 + -(-(sizes - WINDOW) // step), (sizes > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    local = (number * step)[:, None] + np.arange(WINDOW)[None, :]
    scored = (local < sizes[owner][:, None]) & ((number == 0)[:, None] | (np.arange(WINDOW) >= OVERLAP)[None, :])
    return (np.cumsum(sizes) - sizes)[owner][:, None] + np.minimum(local, sizes[owner][:, None] - 1), scored


@dataclass(frozen=True)
class WordShares:
    """Probabilities of words given their first ids, from the counts of all training words."""

    total: np.ndarray  # words that begin with each id, counted
    distinct: np.ndarray  # different words that begin with it
    off: float  # what is taken off each word's count
    spelling: np.ndarray  # class of each id
    pieces: np.ndarray  # of each class, natural logarithms of the shares of the ids that follow; the last is the word's end
    uses: np.ndarray  # how often each id is in the training words, counted

    def given_first(self, flat: np.ndarray, sizes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The probability of each word given its first id; flat, sizes: the words' ids, each with an end; count: in the training words."""
        start = np.cumsum(sizes) - sizes
        share = np.zeros(len(flat))
        share[1:] = self.pieces[self.spelling[flat[:-1]], flat[1:]]
        share[start] = 0
        spelled, first = np.exp(np.add.reduceat(share, start)), flat[start]
        total = np.maximum(self.total[first], 1e-9)
        counted = np.maximum(count - self.off, 0) / total + self.off * self.distinct[first] / total * spelled
        return np.where(self.total[first] > 0, counted, spelled)


@dataclass(frozen=True)
class LanguageModel:
    weights: dict[str, np.ndarray]
    classes: np.ndarray  # of each id
    within: np.ndarray  # each id's share of its class
    plain: np.ndarray  # each id's share of all places
    begins: np.ndarray | None = None  # does an id begin a word or end the text

    def places(self, ids: np.ndarray, sizes: np.ndarray, at_once: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """At each place of concatenated texts of these sizes: the probability of its id, and that a word or the end begins there."""
        y, before, w = self.classes[ids], shifted(ids, sizes), self.weights
        place, scored = window_table(sizes)
        begins = np.ones(len(self.classes), dtype=bool) if self.begins is None else self.begins
        #: sums over all classes, and over those of ids that begin words
        of_class = np.ones((CLASSES, 2), dtype=np.float32)
        of_class[:, 1] = np.bincount(self.classes[begins], minlength=CLASSES) > 0
        dense, out, new = with_bias(w), np.zeros(len(ids)), np.zeros(len(ids))
        for i in range(0, len(place), at_once):
            p, use = place[i : i + at_once], scored[i : i + at_once]
            h, at = attend(w, before[p])[-1][use.reshape(-1)], p[use]
            z = h @ dense
            if z.max(initial=0) > _SAFE:
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            total = z @ of_class
            out[at], new[at] = z[np.arange(len(at)), y[at]] / total[:, 0], total[:, 1] / total[:, 0]
        plain_new = self.plain[begins[: len(self.plain)]].sum()
        return (1 - SHARE) * out * self.within[ids] + SHARE * self.plain[ids], (1 - SHARE) * new + SHARE * plain_new

    def id_scores(self, ids: np.ndarray, sizes: np.ndarray, at_once: int = 32) -> np.ndarray:
        """log10 probability of the id at each place of concatenated texts of these sizes."""
        return np.log10(self.places(ids, sizes, at_once)[0])

    def word_scores(self, ids: np.ndarray, sizes: np.ndarray, count: np.ndarray, of_words: WordShares) -> np.ndarray:
        """log10 probability of each word and end of concatenated texts; count: of each, in the training words."""
        p, new = (np.log10(x) for x in self.places(ids, sizes))
        begins, end = self.begins[ids], len(self.classes) - 1
        start = np.flatnonzero(begins)
        first, after = p[start] - new[start], np.append(start[1:], len(ids))
        spelled = np.add.reduceat(np.where(begins, 0, p), start)
        spelled[:-1] += new[start[1:]]
        by_counts = of_words.given_first(np.insert(ids, after, end), after - start + 1, count)
        return first + np.where(ids[start] == end, 0, np.log10((1 - MIX) * by_counts + MIX * 10**spelled))


def codes(size: int, length: int = NEAR, seed: int = 4) -> np.ndarray:
    """A random vector of each id; whole numbers, so that their sums are exact in any order."""
    return np.rint(np.random.default_rng(seed).standard_normal((size, length)) * 64).astype(np.int32)


def encoded_texts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of all texts of a batch and how many each text has."""
    column = b.column(b.schema.get_field_index("ids"))
    yield column.flatten().to_numpy().astype(np.int64), column.value_lengths().to_numpy().astype(np.int64)


def add_neighbours(total: np.ndarray, code: np.ndarray, ids: np.ndarray, sizes: np.ndarray, at_once: int = 50_000) -> None:
    """Adds to each id's row of total the codes of the SIDE ids on either side of it, within its text."""
    ends, rows = np.cumsum(sizes), np.ascontiguousarray(code.T)
    begin, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    for a in range(0, len(ids), at_once):
        b = min(a + at_once, len(ids))
        lo, i, own = max(0, a - SIDE), np.arange(a, b), ids[a:b]
        some, sums = ids[lo : b + SIDE], np.zeros(min(len(ids), b + SIDE) - lo + 1, dtype=np.int32)
        up, down = np.minimum(i + SIDE + 1, end[a:b]) - lo, np.maximum(i - SIDE, begin[a:b]) - lo
        for j, row in enumerate(rows):
            one = row[some]
            np.cumsum(one, out=sums[1:])
            # whole numbers, exact as doubles
            total[:, j] += np.bincount(own, weights=sums[up] - sums[down] - one[a - lo : b - lo], minlength=len(total)).astype(np.int64)


def summed(rows: DataFrame, run, names: list[str]) -> dict[str, np.ndarray]:
    """Sums by id of what `run` yields, batches with id and `names`; one row for each id reaches the driver.

    Ids are those of the vocabulary, or, for what follows them, at most SPELLINGS times as many: bounds that don't follow the input.
    """
    each = rows.mapInArrow(run, "id int, " + ", ".join(f"{n} double" for n in names))
    got = each.groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    return {n: got[n].to_numpy() for n in ("id", *names)}


def neighbours(training: DataFrame, size: int) -> np.ndarray:
    """For each first id, the sum of the codes around it in all encoded training texts (whole numbers, exact in any order)."""
    names = [f"n{i}" for i in range(NEAR)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, total, seen = codes(size), np.zeros((size, NEAR), dtype=np.int64), np.zeros(size, dtype=bool)
        for b in batches:
            for ids, sizes in encoded_texts(b):
                add_neighbours(total, code, ids, sizes)
                seen[ids] = True
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 10_000):
            some = at[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(total[some, j].astype(np.float64)) for j in range(NEAR)]], names=["id", *names])

    got, out = summed(training.select("ids"), run, names), np.zeros((size, NEAR), dtype=np.float32)
    out[got["id"]] = np.stack([got[n] for n in names], axis=1)
    return out


def clusters(v: np.ndarray, weight: np.ndarray, k: int, seed: int = 4) -> np.ndarray:
    """The number of the nearest of k centres for each row of v, by twelve rounds of k-means."""
    draw, k = np.random.default_rng(seed), min(k, len(v))
    middle, near_to = v[draw.choice(len(v), k, replace=False, p=weight / weight.sum())], np.zeros(len(v), dtype=np.int64)
    for _ in range(12):
        near_to = ((v * v).sum(1)[:, None] - 2 * v @ middle.T + (middle * middle).sum(1)[None, :]).argmin(axis=1)
        for j in range(k):
            if (near_to == j).any():
                middle[j] = np.average(v[near_to == j], axis=0, weights=weight[near_to == j])
    return near_to


def class_table(near: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A class for each id: the most frequent have their own, all others with a count are clustered by the ids around them.

    Ids that begin words (and the end, the last id) share no class with ids inside words. Ids without a count have a
    class of either kind.
    """
    size = len(counts)
    classes = np.where(begins, CLASSES - 1, CLASSES - 3)
    order = np.argsort(-counts, kind="stable")
    own = [i for i in order[:SINGLE] if counts[i] > 0 and i != size - 1]
    rest, at = np.setdiff1d(np.flatnonzero(counts > 0), [*own, size - 1]), SINGLE
    kinds = (CLASSES - SINGLE - 3) // 2
    for some in (rest[begins[rest]], rest[~begins[rest]]):
        if len(some):
            v = near[some] / (np.linalg.norm(near[some], axis=1, keepdims=True) + 1e-6)
            v = np.concatenate([v, np.log1p(counts[some, None]) * 0.05], axis=1)
            classes[some] = at + clusters(v, np.sqrt(1.0 + counts[some]), kinds)
        at += kinds
    classes[own] = np.arange(len(own))
    classes[size - 1] = CLASSES - 2
    return classes


def one_round(training: DataFrame, classes: np.ndarray, weights: dict[str, np.ndarray], passes: int = 1) -> dict[str, np.ndarray]:
    """A round of training over the whole encoded texts of `training`: each task descends from `weights` on its documents.

    The dense results are averaged by the tasks' places, an id's embedding by how often each task saw the id. A few rows
    of weights and one for each id reach the driver. How rows lie in tasks has an influence on the weights.
    """
    shared = training.sparkSession.sparkContext.broadcast((classes, weights))
    names = [f"x{i}" for i in range(WIDTH)]
    sizes = {k: weights[k].size for k in DENSE}
    total, size = sum(sizes.values()), len(weights["E"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = shared.value
        down, n = train_on_stream(start, (x for b in batches for x in encoded_texts(b)), own, passes=passes)
        if not n:
            return
        flat = np.zeros(-(-total // WIDTH) * WIDTH, dtype=np.float32)
        flat[:total] = np.concatenate([down.w[k].ravel() for k in DENSE])
        at = np.flatnonzero(down.seen)
        #: the dense weights follow the embeddings
        keys = np.concatenate([at, size + np.arange(len(flat) // WIDTH)])
        weight = np.concatenate([down.seen[at], np.full(len(flat) // WIDTH, n)]).astype(np.float64)
        values = np.concatenate([down.w["E"][at], flat.reshape(-1, WIDTH)]).astype(np.float64) * weight[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(weight), *[pa.array(values[:, i]) for i in range(WIDTH)]], names=["id", "n", *names])

    got = summed(training.select("ids"), run, ["n", *names])
    if not len(got["id"]):
        return weights
    values = (np.stack([got[x] for x in names], axis=1) / got["n"][:, None]).astype(np.float32)
    out, of_id = {k: v.copy() for k, v in weights.items()}, got["id"] < size
    out["E"][got["id"][of_id]] = values[of_id]
    flat, begin = values[~of_id][np.argsort(got["id"][~of_id])].ravel(), 0
    for k in DENSE:
        out[k] = flat[begin : begin + sizes[k]].reshape(weights[k].shape)
        begin += sizes[k]
    return out


def coded_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(doc_id, held_out, part, text) as places of words in a dictionary for each group p of documents.

    Rows of texts have doc_id, held_out, part and at, the places of the text's words. A group's words are in one row for
    each bucket of words (by a hash): their places, the words, a line each, and c, their counts in the group's training
    documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, size, count = TaskContext.get().partitionId() << 32, 0, np.zeros(0, dtype=np.int64)
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__

        def rows(n: int, **columns) -> pa.RecordBatch:
            given = {"p": pa.array(np.full(n, p, dtype=np.int64)), **columns}
            return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in _CODED], schema=_CODED)

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(place)
            of = np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % buckets
            order = np.argsort(of, kind="stable")
            packs = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if words else []
            for i in range(0, len(packs), 64):
                some = packs[i : i + 64]
                lines = [b"\n".join([words[i] for i in at]) for at in some]
                yield rows(len(some), bucket=pa.array([of[at[0]] for at in some], pa.int32()), place=pa.array(map(_planes, some), pa.binary()), words=pa.array(lines, pa.binary()), c=pa.array([_planes(count[at]) for at in some], pa.binary()))

        for b in batches:
            held, own = b.column(1).to_numpy(zero_copy_only=False).astype(bool), []
            for t in texts(b, "text"):
                ws = t.translate(LOWER).split()
                own.append(np.fromiter(map(place.__getitem__, ws), dtype=np.int32, count=len(ws)))
                size += len(t)
            trained = [x for x, out in zip(own, held) if not out]
            grown = np.bincount(np.concatenate(trained), minlength=len(place)) if trained else np.zeros(len(place), dtype=np.int64)
            grown[: len(count)] += count
            count = grown
            yield rows(len(own), doc_id=b.column(0), held_out=b.column(1), part=b.column(2), at=pa.array(list(map(_planes, own)), pa.binary()))
            if size >= GROUP_BYTES:
                yield from dictionary()
                place.clear()
                p, size, count = p + 1, 0, np.zeros(0, dtype=np.int64)
        yield from dictionary()

    return docs.select("doc_id", "held_out", "part", "text").mapInArrow(run, "p long, doc_id long, held_out boolean, part int, at binary, bucket int, place binary, words binary, c binary")


_CODED = pa.schema([("p", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("part", pa.int32()), ("at", pa.binary()), ("bucket", pa.int32()), ("place", pa.binary()), ("words", pa.binary()), ("c", pa.binary())])


def _planes(x: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers as their lowest bytes, then their next ones, and so on: most are small, so this takes little room once compressed."""
    return x.astype(kind).view(np.uint8).reshape(-1, int(kind[2:])).T.tobytes()


def _numbers(planes: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(int(kind[2:]), -1).T.copy().view(kind).reshape(-1)


def _joined(column, kind: str = "<i4") -> np.ndarray:
    """The numbers of all rows in one row."""
    return np.concatenate([np.zeros(0, dtype=kind), *[_numbers(x, kind) for x in column.to_pylist()]])


def _type(end: int) -> type:
    """The type of stored ids, of which end is the last."""
    return np.uint16 if end < 1 << 16 else np.int32


#: Words in one row: of each its place in a group's dictionary, its count in all training texts and how many ids it has, and all ids as bytes of `_type`.
WORDS = "p long, place binary, c binary, n binary, ids binary"
_WORDS = pa.schema([("p", pa.int64()), ("place", pa.binary()), ("c", pa.binary()), ("n", pa.binary()), ("ids", pa.binary())])


def _encoded(coder: Subwords, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one row, and how many each has."""
    ids = list(map(coder.ids, words))
    n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype=_type(coder.end), count=int(n.sum())), n


def with_ids(words: DataFrame, tokenizer) -> DataFrame:
    """words(word, c), each word once, as rows of WORDS without a group."""
    shared = words.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(shared.value)
        for b in batches:
            flat, n = _encoded(coder, b.column(0).to_pylist())
            yield pa.RecordBatch.from_pylist([{"c": _planes(b.column(1).to_numpy(), "<i8"), "n": _planes(n), "ids": flat.tobytes()}], _WORDS)

    return words.select("word", "c").mapInArrow(run, WORDS)


def counted_words(packs: DataFrame, tokenizer) -> DataFrame:
    """The groups' words (p, bucket, place, words, c) with their counts in all training texts and their ids, as rows of WORDS.

    One row for each of packs, and one without a group for each bucket, in which each word is once.
    """
    shared = packs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(t: pa.Table) -> pa.Table:
        lines = [x.split(b"\n") for x in t["words"].to_pylist()]
        stop = np.cumsum([len(x) for x in lines])
        coded = pa.array(chain.from_iterable(lines), pa.binary()).dictionary_encode()
        of, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # whole numbers, exact as doubles
        total = np.bincount(of, weights=_joined(t["c"]), minlength=len(words)).astype(np.int64)
        flat, n = _encoded(subwords(shared.value), words)
        begin = np.cumsum(n) - n
        out = [{"c": _planes(total, "<i8"), "n": _planes(n), "ids": flat.tobytes()}]
        for p, place, some in zip(t["p"].to_pylist(), t["place"].to_pylist(), np.split(of, stop[:-1])):
            many = n[some]
            ids = flat[np.repeat(begin[some] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            out.append({"p": p, "place": place, "c": _planes(total[some], "<i8"), "n": _planes(many), "ids": ids.tobytes()})
        return pa.Table.from_pylist(out, _WORDS)

    return packs.select("p", "bucket", "place", "words", "c").groupBy("bucket").applyInArrow(run, WORDS)


def _trained(b: pa.RecordBatch, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row (c, n, ids): the counts of its words of training, their ids in one row, each word followed by the end's id, and how many each has with it."""
    for c, n, ids in zip(*(x.to_pylist() for x in b.columns)):
        count, many = _numbers(c, "<i8"), _numbers(n).astype(np.int64)
        keep = count > 0
        if keep.any():
            flat = np.frombuffer(ids, dtype=_type(end)).astype(np.int64)[np.repeat(keep, many)]
            yield count[keep], np.insert(flat, np.cumsum(many[keep]), end), many[keep] + 1


def _flat(coder: Subwords, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one row, each word followed by the end's id, and how many each has with it."""
    flat, n = _encoded(coder, words)
    return np.insert(flat.astype(np.int64), np.cumsum(n), coder.end), n + 1


def word_shares(words: DataFrame, ends: int, tokenizer) -> WordShares:
    """From the training words (word, c, or WORDS): how often ids begin words, and what follows an id within different words."""
    size, encoded = max(tokenizer[0].values()) + 2, words if "ids" in words.columns else with_ids(words, tokenizer)
    few_at, names = size, ["total", "distinct", "uses", *[f"v{i}" for i in range(FOLLOW)]]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codes(size, FOLLOW)
        sums, few = np.zeros((size, len(names))), np.zeros(3)
        for count, flat, n in (x for b in batches for x in _trained(b, size - 1)):
            first, last = np.cumsum(n) - n, np.cumsum(n) - 1
            np.add.at(sums[:, 0], flat[first], count)
            np.add.at(sums[:, 1], flat[first], 1)
            np.add.at(sums[:, 2], flat, np.repeat(count, n))
            follows = np.delete(np.arange(1, len(flat) + 1), last)
            follows = follows[np.argsort(flat[follows - 1].astype(_type(size)), kind="stable")]
            before = flat[follows - 1]
            start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
            sums[before[start], 3:] += np.add.reduceat(code[flat[follows]], start, axis=0)
            few += np.bincount(np.minimum(count, 3) - 1, minlength=3)
        at = np.flatnonzero(np.abs(sums).sum(axis=1))
        rows = np.concatenate([sums[at], [[few[0], few[1]] + [0.0] * (FOLLOW + 1)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, few_at).astype(np.int32)), *[pa.array(rows[:, j]) for j in range(len(names))]], names=["id", *names])

    trained = encoded.where("p IS NULL").select("c", "n", "ids")
    got, sums = summed(trained, begin, names), np.zeros((size + 1, len(names)))
    sums[got["id"]] = np.stack([got[n] for n in names], axis=1)
    once, twice = sums[few_at, :2]
    #: Ney's estimate of what to take off, from the words that occur once and twice
    off = once / (once + 2 * twice) if once else 0.5
    total, distinct, uses, after = sums[:-1, 0], sums[:-1, 1], sums[:-1, 2], sums[:-1, 3:]
    length = np.linalg.norm(after, axis=1)
    spelling, some = np.zeros(size, dtype=np.int64), np.flatnonzero(length)
    if len(some):
        spelling[some] = clusters(after[some] / length[some, None], np.sqrt(length[some]), SPELLINGS)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(counts.astype(np.float64))], names=["id", "n"])

        for _, flat, sizes in (x for b in batches for x in _trained(b, size - 1)):
            held.append(np.delete(spelling[flat[:-1]] * size + flat[1:], np.cumsum(sizes)[:-1] - 1))
            n += len(held[-1])
            if n > 1_000_000:
                yield counted()
                n = 0
        if held:
            yield counted()

    got, later = summed(trained, go_on, ["n"]), np.zeros(SPELLINGS * size, dtype=np.float32)
    later[got["id"]] = got["n"]
    later = later.reshape(SPELLINGS, size)
    over_all = (later.sum(axis=0) + 0.5) / (later.sum(dtype=np.float64) + 0.5 * size)
    share = (later + (PRIOR * over_all).astype(np.float32)) / (later.sum(axis=1, keepdims=True) + PRIOR)
    total[-1] = distinct[-1] = uses[-1] = ends
    return WordShares(total, distinct, float(min(0.95, max(0.05, off))), spelling, np.log(share, out=share), uses)


def encode_texts(rows: DataFrame, words: DataFrame, totals: tuple[int, int, int], tokenizer) -> DataFrame:
    """Coded texts as all their subword ids, the counts of their words, and the figures that need no context.

    rows: the texts, (p, doc_id, held_out, part, at); words: the words of every group, WORDS. Every text ends with the
    end's id, and its counts with the end's. known_base is the part of base_score that tokens of training have.
    """
    tokens, distinct, ends = totals
    end = max(tokenizer[0].values()) + 1
    schema = "doc_id long, held_out boolean, part int, n_tokens long, n_known long, base_score double, known_base double, ids array<int>, counts array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, n = _joined(right["place"]), _joined(right["n"]).astype(np.int64)
        flat, many = np.frombuffer(b"".join(right["ids"].to_pylist()), dtype=_type(end)), len(n)
        #: by place; the last is the end's
        begin, size, count = np.empty(many + 1, dtype=np.int64), np.ones(many + 1, dtype=np.int64), np.full(many + 1, ends, dtype=np.int64)
        begin[place], size[place], count[place] = np.cumsum(n) - n, n, _joined(right["c"], "<i8")
        flat, begin[many] = np.append(flat, end).astype(np.int32), len(flat)
        base = np.log10(count + 0.5) - np.log10(tokens + 0.5 * (distinct + 1))
        out, at = [], left["at"].combine_chunks()
        many_of = pc.binary_length(at).to_numpy().astype(np.int64) // 4
        stop = np.cumsum(many_of)
        i = 0
        while i < left.num_rows:
            j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + WORDS_AT_ONCE, side="right")))
            words_of = many_of[i:j]
            own = np.insert(np.concatenate([_numbers(x) for x in at.slice(i, j - i).to_pylist()]), np.cumsum(words_of), many)
            first = np.cumsum(words_of + 1) - words_of - 1
            known, n = count[own] > 0, size[own]
            ids = flat[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            base_of = base[own]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)).astype(np.int32)), pa.array(v)) for k, v in ((np.add.reduceat(n, first), ids), (words_of + 1, np.minimum(count[own], 2**31 - 1).astype(np.int32)))]
            sums = [pa.array(np.add.reduceat(x, first)) for x in (known.astype(np.int64), base_of, np.where(known, base_of, 0))]
            told = [left[c].slice(i, j - i).combine_chunks() for c in ("doc_id", "held_out", "part")]
            out.append(pa.table([*told, pa.array(words_of + 1), *sums, *lists], names=names))
            i = j
        return pa.concat_tables(out)

    return rows.groupBy("p").cogroup(words.where("p IS NOT NULL").groupBy("p")).applyInArrow(run, schema)


def fit_model(training: DataFrame, counts: np.ndarray, begins: np.ndarray) -> LanguageModel:
    """Learns classes and weights from all encoded training texts (part, ids); counts: of each id in them, begins: does it begin words."""
    classes, places = class_table(neighbours(training, len(counts)), counts, begins), int(counts.sum())
    in_class = np.bincount(classes, counts + 0.5, minlength=CLASSES)
    weights, start = start_weights(len(counts), (in_class + 0.5) / (in_class + 0.5).sum()), 0
    passes, tasks = max(1, -(-LEAST_PLACES // max(1, places))), training.rdd.getNumPartitions()
    for i, to in enumerate(ROUNDS):
        some = training.where((F.col("part") >= start) & (F.col("part") < to))
        # few places: few tasks, so that each sees enough of them and their rows of weights stay few, in an order that does not depend on how rows lay
        wanted = max(1, min(tasks, places * (to - start) // PARTS // TASK_PLACES))
        if i == 0:
            wanted = min(wanted, max(1, tasks // 12))
        if wanted < tasks:
            some = some.repartition(wanted, F.xxhash64("ids")).coalesce(wanted).sortWithinPartitions(F.xxhash64("ids"))
        weights = one_round(some, classes, weights, passes)
        start = to
    return LanguageModel(weights, classes, (counts + 0.5) / in_class[classes], (counts + 0.5) / (counts + 0.5).sum(), begins)


def score_encoded(encoded: DataFrame, model: LanguageModel, of_words: WordShares) -> DataFrame:
    """encoded with `score` and `known_score`: the log10 probabilities of each text, all and those of known tokens."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, of_words))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        own, of = shared.value
        for b in batches:
            column = b.column(b.schema.get_field_index("counts"))
            count, words_of = column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)
            out = [np.zeros((2, 0))]
            for ids, sizes in encoded_texts(b):
                if len(sizes):
                    scores = own.word_scores(ids, sizes, count, of)
                    out.append(np.add.reduceat(np.stack([scores, np.where(count > 0, scores, 0)]), np.cumsum(words_of) - words_of, axis=1))
            yield [pa.array(x) for x in np.concatenate(out, axis=1)]

    return with_columns(encoded, "ids", [T.StructField(n, T.DoubleType(), True) for n in ("score", "known_score")], fill)


def lm_scores(docs: DataFrame, tokenizer: tuple[dict[bytes, int], str]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_base and known_score of docs(doc_id, text).

    Texts are lower-cased (A-Z) and cut into words; the text's end is one more token. Null texts are empty and have only
    the end. known_base and known_score are the parts of base_score and score that tokens seen in training have: the base
    gives every other word one share and doesn't spell it, the model spells it. Documents without an id are scored and count as training; repeated rows count and score each. Texts are
    whole, of any length: a group of documents that share a dictionary has about GROUP_BYTES of text, or one document.
    Columns other than the two are not read, so none can clash. An empty table gives no rows. tokenizer: ranks and
    pattern, which are broadcast and of fixed size; ids that begin a word, and no others, begin with a space. How rows lie in tasks has an influence on the weights, and so on the
    last digits of the scores.
    """
    part = F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(PARTS)).cast("int").alias("part")
    # more buckets for more input, so that the words of one stay few
    buckets = BUCKETS * docs.rdd.getNumPartitions()
    coded = written(coded_texts(docs.select("doc_id", fold(5, 1).alias("held_out"), part, "text"), buckets), "coded", "zstd")
    rows, packs = coded.where("at IS NOT NULL"), coded.where("words IS NOT NULL")
    words = written(counted_words(packs, tokenizer), "words", "zstd")
    ends = rows.where("NOT held_out").count()
    of_words = word_shares(words, ends, tokenizer)
    totals = (int(of_words.total.sum()), int(of_words.distinct[:-1].sum()) + (ends > 0), ends)
    encoded = written(encode_texts(rows.select("p", "doc_id", "held_out", "part", "at"), words, totals, tokenizer), "encoded", "zstd")
    begins = np.zeros(len(of_words.uses), dtype=bool)
    begins[[r for t, r in tokenizer[0].items() if t.startswith(b" ")] + [len(begins) - 1]] = True
    model = fit_model(encoded.where("NOT held_out").select("part", "ids"), of_words.uses, begins)
    scored = score_encoded(encoded, model, of_words)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals[0]).cast("long").alias("train_tokens"), "base_score", "score", "known_base", "known_score")
