"""Document fingerprints by Order MinHash.

The k-mers of code points are numbered by occurrence, so that repeats differ. For each of m orders the l least numbered
k-mers are selected, put back into text order, and hashed as a tuple. Two texts share an entry if the same k-mers are
selected in the same order, which makes the likeness follow the edit distance rather than the set of k-mers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class OrderMinHash:
    k: int = 8
    l: int = 2  # noqa: E741
    m: int = 32
    seed: int = 7
    cells: int = 1 << 17  # of a work table of orders by k-mers

    def kmers(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of the occurrence-numbered k-mers in text order; a shorter text is one k-mer, an empty one none."""
        c = codes.astype(np.uint64) + np.uint64(1)
        if not len(c):
            return c
        h, have = c, 1
        power = np.array([_ODD])
        while have < min(self.k, len(c)):
            if 2 * have <= min(self.k, len(c)):
                h = h[:-have] * power + h[have:]
                power, have = power * power, 2 * have
            else:
                h, have = h[:-1] * _ODD + c[len(c) - len(h) + 1 :], have + 1
        h = mix(h)
        n = len(h)
        at = np.argsort(h, kind="stable")
        key = h[at]
        again = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(again):
            first = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(n), 0))
            h[at[again]] = mix(h[at[again]] + (again - first[again]).astype(np.uint64) * _ODD)
        return h

    def signature(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        h = self.kmers(codes)
        n, l = len(h), min(self.l, len(h))  # noqa: E741
        draw = np.random.default_rng(self.seed)
        factor = draw.integers(0, 1 << 63, self.m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        flip = draw.integers(0, 1 << 63, self.m, dtype=np.uint64)
        if not n:
            return np.zeros(self.m, dtype=np.uint32)
        out = np.empty(self.m, dtype=np.uint64)
        rows = max(1, self.cells // n)
        most = np.uint64(0xFFFFFFFFFFFFFFFF)
        for a in range(0, self.m, rows):
            f, x = factor[a : a + rows, None], flip[a : a + rows, None]
            table = (h[None, :] ^ x) * f
            every = np.arange(len(table))
            chosen = np.empty((len(table), l), dtype=np.int64)
            for i in range(l):
                chosen[:, i] = table.argmin(axis=1)
                table[every, chosen[:, i]] = most
            chosen.sort(axis=1)
            total = np.full(len(table), self.seed, dtype=np.uint64)
            for i in range(l):
                total = mix(total * _ODD + h[chosen[:, i]])
            out[a : a + rows] = total
        return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / len(a)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def order_minhash(docs: DataFrame, text: str = "text", out: str = "fingerprint", params: OrderMinHash | None = None) -> DataFrame:
    """docs with `out` (string): the hexadecimal Order MinHash signature of each whole text (null as empty: zeros)."""
    from .common import with_columns

    scheme = params or OrderMinHash()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text)).to_pylist()
            yield [pa.array([as_text(scheme.signature(x or "")) for x in column], pa.string())]

    return with_columns(docs, text, [T.StructField(out, T.StringType(), True)], fill)


def _bucket(bounds: list[int], id_col: str):
    """How many of the sorted bounds are at most the id; looked up in two steps, for long lists."""
    if not bounds:
        return F.lit(0)
    size = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    at_most = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(id_col)))
    coarse = at_most(F.array(*[F.lit(g[0]) for g in groups]))
    fine = F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), coarse)
    return F.when(F.col(id_col).isNull(), F.lit(0)).when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * size + at_most(fine))


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ending, doc_id, text): documents dealt by ranges of doc_id, sorted within a range, each range followed by the next one's first document.

    Ranges come from quantiles of the ids; what the driver holds is a few numbers for each range. Repeated ids are
    ordered by text, null ids come first; the range after the last is the first.
    """
    ids = docs.select("doc_id")
    probs = [i / buckets for i in range(1, buckets)]
    found = ids.na.drop().select(F.col("doc_id").cast("double")).approxQuantile("doc_id", probs, 1 / (4 * buckets)) if probs else []
    bounds = sorted({int(x) for x in found})
    dealt = docs.select(_bucket(bounds, "doc_id").alias("bucket"), "doc_id", "text")
    heads = {r["bucket"]: r["head"] for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("n")).select("bucket", F.when(F.col("n") == 0, F.col("head")).alias("head")).collect()}
    there = sorted(heads)
    if not there:
        return dealt.select("bucket", F.lit(0).alias("ending"), "doc_id", "text")
    follows = {b: there[i - 1] for i, b in enumerate(there)}
    pairs = docs.sparkSession.createDataFrame([(heads[b], b, follows[b]) for b in there], "head long, home int, back int")
    #: as many rows as there are ranges
    joined = dealt.join(F.broadcast(pairs), (F.col("bucket") == F.col("home")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    both = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ending")), F.struct(F.col("back").alias("bucket"), F.lit(1).alias("ending")))
    rows = joined.select(F.explode(F.when(F.col("back").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("at"), "doc_id", "text")
    parts = max(1, buckets // 8)
    return rows.select("at.bucket", "at.ending", "doc_id", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "ending", "doc_id", "text")


def edited_pairs(docs: DataFrame, params: OrderMinHash | None = None) -> DataFrame:
    """Fingerprints of every text and of the text whose last half is replaced by the next document's beginning.

    docs has doc_id and text; null texts are empty. One row per input row, also for repeated ids; a table's only
    document follows itself; an empty table gives no rows.
    """
    scheme = params or OrderMinHash()
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None
        for batch in batches:
            out: list[tuple] = []
            for bucket, ending, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if ending and before is None:
                    continue  # further rows of the next range's first id
                text = text or ""
                sign = scheme.signature(text) if before is None or before[2] != text else before[3]
                if before is not None:
                    _, own, old, old_sign = before
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    new = scheme.signature(edited)
                    out.append((own, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(old_sign), as_text(new), likeness(old_sign, new), likeness(old_sign, sign)))
                before = None if ending else (bucket, key, text, sign)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    return in_order(docs, buckets).mapInArrow(run, schema)
