"""Ranked lexical search over a bit-sliced index of impacts.

What a term adds to a document's score, its impact, is a whole number. For each block of documents and each term, bit i of
the impacts is one bitmap over the block's documents. A query adds its terms' numbers for all documents of a block at once,
by and, or and exclusive or of bitmaps with a carry, and finds the k greatest sums by descending from the most significant
bitmap: those with the bit set go first as long as they are no more than are still wanted.

Tables are read twice: once to count each document's terms (written, with only the terms asked for), once as blocks. The
bitmaps of all terms would be far larger than the texts, since most terms are rare, so a block's index has the terms that
the queries ask for. Queries come in groups of at most TERMS different terms; a group is all that is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written

#: Documents of a block, a multiple of 64, and different terms of a group of queries.
BLOCK, TERMS = 1 << 13, 2_000
#: Parts that an item's candidates are ranked in before they are ranked together.
PARTS = 32
#: Bytes of terms: ASCII letters in lower case and digits, and all bytes that are no ASCII; the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


class Slices:
    """Whole numbers of a block's documents as bitmaps: row i of `bits` has bit i of all numbers, 64 documents a word."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, places: np.ndarray, numbers: np.ndarray, size: int) -> "Slices":
        """`numbers` at `places`, zero elsewhere, for `size` documents."""
        n = int(numbers.max(initial=0)).bit_length()
        set_ = (numbers[None, :] >> np.arange(n)[:, None]) & 1
        plain = np.zeros((n, -(-size // 64) * 64), dtype=np.uint8)
        plain[:, places] = set_
        return cls(np.packbits(plain, axis=1, bitorder="little").view(np.uint64))

    def plus(self, other: "Slices") -> "Slices":
        """The sums, by a carry from bit to bit."""
        a, b = (self.bits, other.bits) if len(self.bits) >= len(other.bits) else (other.bits, self.bits)
        out = np.empty((len(a) + 1, a.shape[1]), dtype=np.uint64)
        carry = np.zeros(a.shape[1], dtype=np.uint64)
        for i in range(len(a)):
            if i < len(b):
                half = a[i] ^ b[i]
                out[i] = half ^ carry
                carry = (a[i] & b[i]) | (half & carry)
            else:
                out[i] = a[i] ^ carry
                carry = a[i] & carry
        out[-1] = carry
        return Slices(out if carry.any() else out[:-1])

    def top(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the k greatest numbers above zero, all if there are fewer; of equal ones those with the least keys."""
        count = lambda x: int(np.bitwise_count(x).sum())
        sure, maybe = np.zeros(self.bits.shape[1], dtype=np.uint64), np.bitwise_or.reduce(self.bits, axis=0) if len(self.bits) else np.zeros(self.bits.shape[1], dtype=np.uint64)
        have, open_ = 0, count(maybe)
        for row in self.bits[::-1]:
            if have + open_ <= k:
                break
            high = maybe & row
            n = count(high)
            if have + n > k:
                maybe, open_ = high, n
            else:
                sure, maybe = sure | high, maybe & ~row
                have, open_ = have + n, open_ - n
        at, rest = (np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (sure, maybe))
        if have + len(rest) > k:
            rest = rest[np.argsort(keys[rest], kind="stable")[: k - have]]
        places = np.concatenate([at, rest])
        numbers = np.zeros(len(places), dtype=np.int64)
        for i, row in enumerate(self.bits):
            numbers |= ((row[places // 64] >> (places % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
        return places, numbers


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of docs(doc_id, text) with at least one term: how many it has, and how often which of the vocabulary's."""
    shared, width = docs.sparkSession.sparkContext.broadcast(vocabulary), max(1, len(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            sizes, codes = [], []
            for t in texts(b, "text"):
                found = terms(t)
                sizes.append(len(found))
                codes.append(np.fromiter(map(known.get, found, repeat(-1)), dtype=np.int64, count=len(found)))
            n, code = np.array(sizes, dtype=np.int64), np.concatenate([*codes, np.zeros(0, dtype=np.int64)])
            owner = np.repeat(np.arange(len(n)), n)
            pairs, times = np.unique((owner * width + code)[code >= 0], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(n) + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((pairs % width).astype(np.int32), times.astype(np.int64))]
            out = pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n), *lists], names=["doc_id", "n", "terms", "times"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def impacts(times: np.ndarray, n: np.ndarray, documents: int, length: int, weight: np.ndarray) -> np.ndarray:
    """What a term adds for a document: weight * (10^9 tf div (1000 tf + 8 m)), with m = 10 + 90 n documents div length; 64-bit numbers."""
    m = 10 + 90 * n * documents // length
    return weight * (1_000_000_000 * times // (1000 * times + 8 * m))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def best_of_blocks(counts: DataFrame, queries: list[list[int]], documents: int, length: int, weights: np.ndarray, k: int, block: int = BLOCK) -> DataFrame:
    """(query, doc_id, score): of every block of counts(doc_id, n, terms, times) the k best documents of each query, a list of term numbers."""
    shared = counts.sparkSession.sparkContext.broadcast((queries, weights))

    def flat(column: pa.ListArray) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of `block` rows, the last one shorter."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            at = 0
            while at < len(b):
                part = b.slice(at, block - sum(map(len, held)))
                held.append(part)
                at += len(part)
                if sum(map(len, held)) == block:
                    yield pa.concat_batches(held)
                    held = []
        if held:
            yield pa.concat_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weighs = shared.value
        for b in blocks(batches):
            column = lambda c, b=b: b.column(b.schema.get_field_index(c))
            ids = column("doc_id")
            keys = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            term, times = flat(column("terms")), flat(column("times"))
            place = np.repeat(np.arange(len(b)), np.diff(column("terms").offsets.to_numpy()))
            value = impacts(times, column("n").to_numpy()[place], documents, length, weighs[term])
            by = np.argsort(term, kind="stable")
            ends = np.searchsorted(term[by], np.arange(len(weighs) + 1))
            index = {t: Slices.of(place[by[i:j]], value[by[i:j]], len(b)) for t, (i, j) in enumerate(zip(ends, ends[1:])) if j > i}
            which, rows, scores = [], [], []
            for q, wanted in enumerate(asked):
                total = None
                for t in wanted:
                    if t in index:
                        total = total.plus(index[t]) if total else index[t]
                if total:
                    places, numbers = total.top(k, keys)
                    which.append(np.full(len(places), q, dtype=np.int32))
                    rows.append(places)
                    scores.append(numbers)
            if which:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which)), ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], names=["query", "doc_id", "score"])

    return counts.mapInArrow(run, "query int, doc_id long, score long")


def query_groups(items: DataFrame, most: int = TERMS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """items(item_id, text) as (item_id, different terms), in groups of at most `most` different terms; one item with more is a group of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(t))) for t in texts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("item_id")), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    split = items.select("item_id", "text").mapInArrow(run, "item_id long, terms array<binary>")
    merged = split.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)
    group: list[tuple[int | None, list[bytes]]] = []
    have: set[bytes] = set()
    for r in merged.orderBy("item_id").toLocalIterator():
        own = [bytes(t) for t in r["terms"]]
        if group and len(have.union(own)) > most:
            yield group
            group, have = [], set()
        group.append((r["item_id"], own))
        have.update(own)
    if group:
        yield group


def ranked(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k first of each key's rows by descending score, ascending doc_id (nulls last), with their rank; first within parts of a key."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)).alias("part")
    some = rows.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))).where(F.col("rank") <= k).drop("part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of items(item_id, text) the k documents of docs(doc_id, text) with the highest scores above 0.

    Every row of docs is a document, also with a repeated or null id (which comes last among equal scores) and a repeated
    text. Null and empty texts have no terms: they count nowhere and match nothing. Items that share an id are one item
    with the terms of all. Other columns are ignored. Without documents or items there are no rows. Long texts take memory
    for their list of terms, no more. Scores are 64-bit numbers, which fit while 90 times a document's terms times the
    number of documents does.
    """
    spark, out = docs.sparkSession, None
    for group in query_groups(items, TERMS):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in group for t in own}))}
        counts = written(counted(docs, vocabulary), "term-counts")
        documents, length = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = np.zeros(len(vocabulary), dtype=np.int64)
        for t, n in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row for each term of the group
            holding[t] = n
        weights = np.array([weight(documents, int(n)) for n in holding], dtype=np.int64)
        best = best_of_blocks(counts, [[vocabulary[t] for t in own] for _, own in group], documents, length, weights, k)
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(group)], "query int, item_id long")
        found = ranked(best, "query", k).join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
