"""SimHash near-duplicates by meeting in the middle.

Two 64-bit fingerprints that differ in at most three bits have a value between them: one step from the one, at most two
from the other. Every fingerprint emits the variants around it, variants are shuffled, and those that meet are verified.

Three rules keep the variants few without losing a link. A difference of one or three bits joins an even and an odd
number of ones, so only odd fingerprints emit variants two steps away; a difference of two joins equals in this respect,
which meet one step from both. Of three differing bits two lie in the same half of the word, so two steps stay within a
half. All that meet at a variant which an even fingerprint is next to are within three bits of it, and all that are one
step from a variant within two of each other; so each is linked to the least of them, never each to each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, cut, packed, perhaps_among, texts, unpacked, with_columns
from .components import components

BITS, RADIUS = 64, 3


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in more than half of the hashes of the word shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : e - 1], seed) for a, e in zip([0, *ends], ends[size - 1 :])]
    ones = np.zeros(BITS, dtype=np.int64)
    h = np.array(hashes, dtype="<u8")
    for i in range(0, len(h), 50_000):
        some = h[i : i + 50_000]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """docs with `out` (long): the fingerprint of every whole text; null, empty and white texts have zero."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            yield [pa.array(np.array([fingerprint(t) for t in texts(b, text)], dtype=np.uint64).view(np.int64), pa.int64())]

    return with_columns(docs, text, [T.StructField(out, T.LongType(), True)], fill)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: What is flipped in a variant: nothing, one bit, or two of the same half.
MASKS = [0, *(1 << i for i in range(BITS)), *(1 << i | 1 << j for s in (0, BITS // 2) for i, j in combinations(range(s, s + BITS // 2), 2))]


def _masks(codes: list[int]) -> Column:
    return F.array(*[F.lit(_signed(MASKS[c])) for c in codes])


def _variants(fps: DataFrame, codes: list[int]) -> DataFrame:
    """(mid, code): a variant and the number of the mask that gives the fingerprint back; the number shuffles smaller than that."""
    flipped = fps.select("fp", F.posexplode(_masks(codes)).alias("i", "mask"))
    return flipped.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"), (F.col("i") + codes[0]).cast("short").alias("code"))


def _origin() -> Column:
    return F.col("mid").bitwiseXOR(F.element_at(_masks(list(range(len(MASKS)))), F.col("code").cast("int") + 1))


def links(fps: DataFrame) -> DataFrame:
    """(fp, rep): links that join all distinct fingerprints within three bits of each other into the same components."""
    near = _variants(fps, list(range(1, BITS + 1)))
    least = near.groupBy("mid").agg(F.min(_origin()).alias("rep"))
    odd = fps.where(F.bit_count("fp") % 2 == 1)
    far = _variants(odd, [0]).union(_variants(odd, list(range(BITS + 1, len(MASKS)))))
    met = near.union(far).join(least.hint("shuffle_hash"), "mid").select(_origin().alias("fp"), "rep")
    return met.where((F.col("fp") != F.col("rep")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("rep"))) <= RADIUS)).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text).

    component_id is the least doc_id reachable over links of at most three bits, a document's own included. Documents of
    one fingerprint are one class and meet only by it, so copies are never paired. Null ids are carried along and are a
    component's id only if it has no other; an empty table gives no rows.
    """
    prints, groups = near_prints(docs.select("doc_id", "text"))
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def near_prints(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with fp and without text, and (fp, root, component_id) of each fingerprint."""
    prints = cut(simhash(docs).drop("text"))
    #: a class makes up to a thousand variants, so classes are dealt out by their number and not by their few bytes
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).repartition(parts, "fp"))
    joined = components(links(classes.select("fp")), "fp", "rep")
    grouped = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, grouped.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), the fingerprint in hexadecimal."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, with its least doc_id; null texts are near-duplicates of empty ones.

    Of several rows with that id the one with the least fingerprint and hash of its text stays, and where the component has
    no id at all the one with the least of these. Rows that are equal in all of them are told apart by nothing and stay
    as one. Other columns pass through, whatever their names; an empty table gives no rows.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    prints, groups = near_prints(docs.select("doc_id", "text", text.alias("row")))
    named = prints.join(groups, "fp")
    # classes are reduced before components are: no component's rows meet in one task
    per_class = named.groupBy("component_id", "root", "fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "row")).alias("least"))
    kept = per_class.groupBy("component_id", "root").agg(F.min("least").alias("least")).select("least.doc_id", "least.row")
    keys = kept.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("row").alias("_row")).distinct()
    rows = packed(docs, F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), text.alias("_row"))
    on = ["_id", "_none", "_row"]
    met = perhaps_among(rows, keys, on).where("_among").join(keys, on, "left_semi")
    # repeated rows of what is kept
    again = Window.partitionBy(*on).orderBy(F.lit(1))
    return unpacked(met.withColumn("_n", F.row_number().over(again)).where("_n = 1"), docs.columns)
