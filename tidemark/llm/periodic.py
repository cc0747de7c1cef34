"""Runs of repeating words in documents, found on the harmonic grid.

A run is a stretch of words with a smallest period p that is at least twice as long as p and can't be extended. Every
stretch of 2p words holds two neighbouring multiples of p, so for each p only the pairs of places jp and (j+1)p are asked
how far the words after them agree, and how far those before them: n/p pairs for a period, n log n in all. The answers are
least values between two places of the table of longest common prefixes of a suffix array, and of the reversed words' one.

Documents are independent of each other, so a task takes as many as have GROUP words together and works on one array of
their words, in which words of different documents never compare equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, with_columns

#: Words of short documents that are worked on together, and pairs of the grid at a time.
GROUP, PAIRS = 1 << 16, 1 << 19
#: Words of a run at least.
LEAST = 12
_BLOCK = 16


class LeastBetween:
    """The least value between two places of an array: blocks of 16 have running minima from both ends, and whole blocks a sparse table."""

    def __init__(self, values: np.ndarray):
        n = -(-max(1, len(values)) // _BLOCK) * _BLOCK
        self.values = np.full(n, np.iinfo(np.int32).max, dtype=np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, _BLOCK)
        self.head = np.minimum.accumulate(blocks, axis=1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while 2 << len(self.levels) - 1 <= len(blocks):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each pair of places, both included, low <= high."""
        a, b = low // _BLOCK, high // _BLOCK
        found = np.minimum(self.tail[low], self.head[high])
        same = np.flatnonzero(a == b)
        if len(same):
            at, end = low[same], high[same]
            least = self.values[at]
            for _ in range(_BLOCK - 1):
                at = np.minimum(at + 1, end)
                least = np.minimum(least, self.values[at])
            found[same] = least
        between = np.flatnonzero(b - a > 1)
        if len(between):
            first, count = a[between] + 1, b[between] - a[between] - 1
            level = np.frexp(count.astype(np.float64))[1] - 1
            for k in np.unique(level):
                some = level == k
                at, rows = first[some], between[some]
                inner = np.minimum(self.levels[k][at], self.levels[k][at + count[some] - (1 << int(k))])
                found[rows] = np.minimum(found[rows], inner)
        return found


class CommonPrefix:
    """How many symbols two suffixes of a sequence have in common at their beginnings.

    The suffix array is sorted by doubled prefixes; only suffixes that are not yet told apart are sorted again, so prose
    takes two or three short rounds. The ranks of each round give the prefixes that neighbours in the array share.
    Equal symbols never belong to different documents, so no answer reaches over a document's end.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable").astype(np.int64)
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
        rank = np.full(n + 1, -1, dtype=np.int32)
        places = np.arange(n, dtype=np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, places, 0))
        rounds, size = [rank], 1
        while True:
            open_ = ~fresh
            open_[:-1] |= ~fresh[1:]
            slots = np.flatnonzero(open_)
            if not len(slots):
                break
            some = order[slots]
            key = rank[some].astype(np.int64) * (n + 2) + rank[np.minimum(some + size, n)] + 1
            by = np.argsort(key, kind="stable")
            key, some = key[by], some[by]
            order[slots] = some
            changes = np.ones(len(slots), dtype=bool)
            changes[1:] = key[1:] != key[:-1]
            fresh[slots] = changes
            rank = rank.copy()
            rank[some] = np.maximum.accumulate(np.where(changes, slots, 0))
            rounds.append(rank)
            size *= 2
        self.rank = rank
        shared = np.zeros(n, dtype=np.int32)
        close = np.flatnonzero(rounds[0][order[1:]] == rounds[0][order[:-1]])
        if len(close):
            a, b, length = order[close], order[close + 1], np.zeros(len(close), dtype=np.int64)
            for k in range(len(rounds) - 2, -1, -1):
                length += (rounds[k][a + length] == rounds[k][b + length]) * (1 << k)
            shared[close + 1] = length
        self.least = LeastBetween(shared)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of different places."""
        x, y = self.rank[a], self.rank[b]
        return self.least.of(np.minimum(x, y) + 1, np.maximum(x, y))


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def find_runs(symbols: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period), by start and period, of a sequence of documents with so many symbols each.

    Symbols of different documents differ. Starts are places in the whole sequence.
    """
    n = len(symbols)
    none = np.zeros((0, 3), dtype=np.int64)
    if n < 2:
        return none
    starts = np.cumsum(sizes) - sizes
    # every period of every document, and how many pairs of the grid it has
    periods_of = sizes // 2
    period = _ragged(periods_of) + 1
    origin, size = np.repeat(starts, periods_of), np.repeat(sizes, periods_of)
    pairs = (size - 1) // np.maximum(period, 1)
    upto = np.cumsum(pairs)
    after = before = None
    found, at = [none], 0
    while at < len(period):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        p = np.repeat(period[at:to], pairs[at:to])
        first = np.repeat(origin[at:to], pairs[at:to])
        x = first + _ragged(pairs[at:to]) * p
        y = x + p
        # where neither the words here nor those before agree, both answers are zero
        agree = symbols[x] == symbols[y]
        earlier = (x > first) & (symbols[x - 1] == symbols[y - 1])
        ask = np.flatnonzero(agree | earlier)
        at = to
        if not len(ask):
            continue
        if after is None:
            after, before = CommonPrefix(symbols), CommonPrefix(symbols[::-1])
        x, y, p, agree, earlier = x[ask], y[ask], p[ask], np.flatnonzero(agree[ask]), np.flatnonzero(earlier[ask])
        forward, backward = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        forward[agree] = after.of(x[agree], y[agree])
        backward[earlier] = before.of(n - x[earlier], n - y[earlier])
        length = p + forward + backward
        good = (length >= 2 * p) & (length >= least)
        if good.any():
            found.append(np.unique(np.stack([(x - backward)[good], length[good], p[good]], axis=1), axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # a stretch that has several periods has the least one; the others are its multiples
    first_of = np.ones(len(runs), dtype=bool)
    first_of[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first_of]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _runs_of(documents: list[list[bytes]], least: int) -> list[np.ndarray]:
    """The runs of each document's words, with starts in the document."""
    sizes = np.array([len(w) for w in documents], dtype=np.int64)
    words = pa.array([w for d in documents for w in d], pa.binary()).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, dtype=np.int64)
    symbols = np.repeat(np.arange(len(documents)), sizes) * max(1, len(words.dictionary)) + codes
    runs = find_runs(symbols, sizes, least)
    starts = np.cumsum(sizes) - sizes
    owner = np.searchsorted(starts + sizes, runs[:, 0], side="right")
    runs[:, 0] -= starts[owner]
    return np.split(runs, np.searchsorted(owner, np.arange(1, len(documents))))


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [w for w, gone in zip(words, (np.cumsum(change[:-1]) > 0).tolist()) if not gone]


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """docs with `runs`, an array of (start, length, period) by start and period, and `collapsed`, the text's kept words joined by single spaces.

    Words are numbered from 0; a run has at least `least` words and twice its period. Of every run its first period
    stays. Nulls and empty texts have no words, no runs and an empty `collapsed`. Rows are independent: repeated rows, null
    or repeated ids change nothing, columns of other names pass through, those of these names are replaced; an empty table
    gives no rows. A text is one task's work, n log n for n words, and takes some 100 bytes a word, and 4 more for each
    doubling of its longest repeat.
    """
    fields = [T.StructField(names[0], T.ArrayType(RUN)), T.StructField(names[1], T.StringType())]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            documents = [t.split() for t in texts(b, text)]
            found, group, held = [], [], 0
            for d in documents:
                if group and held + len(d) > GROUP:
                    found += _runs_of(group, least)
                    group, held = [], 0
                group.append(d)
                held += len(d)
            if group:
                found += _runs_of(group, least)
            flat = np.concatenate([*found, np.zeros((0, 3), dtype=np.int64)])
            ends = np.cumsum([0, *(len(r) for r in found)]).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=RUN.names)
            yield [pa.ListArray.from_arrays(pa.array(ends), runs), pa.array([b" ".join(collapsed(d, r)).decode() for d, r in zip(documents, found)], pa.string())]

    return with_columns(docs, text, fields, fill)


def with_repeating_tails(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) where a tenth of the texts, chosen by h = crc32(doc_id), have a tail that repeats.

    With g = h div 10 and n words, the words from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8) words from a. Such
    a text is its words, joined by single spaces; all others, and rows without an id or words, are unchanged.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    some = docs.withColumns({"_h": h, "_words": F.when(h % 10 == 0, words)})
    g, n = F.expr("_h div 10"), F.size("_words").cast("long")
    placed = some.withColumns({"_g": g, "_n": n}).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    cycled = placed.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(_words, cast(_a + 1 AS int), cast(_p AS int)), cast(ceil((_n - _a) / _p) AS int))), 1, cast(_n - _a AS int))")
    joined: Column = F.array_join(F.concat(F.expr("slice(_words, 1, cast(_a AS int))"), tail), " ")
    return cycled.select("doc_id", F.when(F.col("_a").isNotNull(), joined).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one (least start, then period, of several), and digests of all runs and of the kept words.

    docs(doc_id, text). Without a run the longest one's four columns are null and the first digest is that of nothing.
    """
    found = periodic_runs(docs).drop("text")
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS slow)))")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.back")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.slow")).alias("period"),
        F.expr("1000 * longest.length div -longest.slow").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
