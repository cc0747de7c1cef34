"""Substring dedup over a compacted de Bruijn graph of word k-mers.

An edge of the graph is a window of words, and leads from the node that is the window without its last word to the node
that is it without its first. Edges that several documents have are the repeated part of the graph. Its nonbranching paths
(inner nodes with one edge in and one out) are compacted by joins with the nodes' degrees; each path keeps the place of its
first source, the document with the least id. Where documents run along a path, the words there are compared with the
words at the source's place before they are cut.

Two exact reductions come before the graph: documents with equal words are one class, of which the least is in the graph;
and of every window the least word 16-mer by hash is its anchor (equal windows have equal anchors), so that windows whose
anchor no other class has never become edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PACKED, join_heavy, memory, packed, perhaps_among, texts, unpacked, with_columns, written
from .omh import mix

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 50, 16
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 21) - 1)
#: Windows whose anchors are found at a time, for their places to fit 21 bits.
STRETCH = 1 << 20
#: Rows of an anchor from which it is kept for its number alone.
MANY = 1000

_powers: list[np.ndarray] = []


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = memory("words")
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, 9)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 15)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


class Spans:
    """Hashes of any span of a word sequence."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _power(len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def stretches(hashes: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run of windows with one anchor, and the anchor's hash."""
    k = min(k, window)
    if len(hashes) < window:
        return (np.zeros(0, np.int32),) * 2 + (np.zeros(0, np.uint64),)
    spans, found = Spans(hashes), []
    for at in range(0, len(hashes) - window + 1, STRETCH):
        n = min(STRETCH, len(hashes) - window + 1 - at) + window - k
        start = np.arange(at, at + n)
        kmer = spans.of(start, start + k)
        least = (kmer & ~_PLACE) | np.arange(n, dtype=np.uint64)
        have, want = 1, window - k + 1
        while have < want:
            step = min(have, want - have)
            least, have = np.minimum(least[:-step], least[step:]), have + step
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        found.append((first + at, last + at, kmer[place[first]]))
    first, last, anchor = (np.concatenate(x) for x in zip(*found))
    return first.astype(np.int32), last.astype(np.int32), anchor


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def profiles(docs: DataFrame) -> DataFrame:
    """docs(doc_id, row, text) without the text but with n_words, whole_sha256 and `same`, a 128-bit digest: all of the words, joined by spaces."""
    fields = [T.StructField("n_words", T.LongType()), T.StructField("whole_sha256", T.StringType()), T.StructField("same", T.BinaryType())]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            found = [t.split() for t in texts(b, "text")]
            joined = [b" ".join(w) for w in found]
            yield [pa.array([len(w) for w in found], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()), pa.array([xxhash.xxh3_128_digest(j) for j in joined], pa.binary())]

    return with_columns(docs, "text", fields, fill).drop("text")


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, class, first, last, anchor): the stretches of every document; class is a hash of all its words."""
    kinds = {"first": (T.IntegerType(), pa.int32()), "last": (T.IntegerType(), pa.int32()), "anchor": (T.LongType(), pa.int64())}
    fields = [T.StructField("class", T.LongType())] + [T.StructField(n, T.ArrayType(t)) for n, (t, _) in kinds.items()]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            found, same = [], []
            for t in texts(b, "text"):
                words = t.split()
                same.append(int.from_bytes(_digest(words)[:8], "big", signed=True))
                found.append(stretches(word_hashes(words), window))
            out = [pa.array(same, pa.int64())]
            for i, (_, kind) in enumerate(kinds.values()):
                ends = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
                flat = np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat).cast(kind)))
            yield out

    listed = with_columns(docs, "text", fields, fill).where(F.size("first") > 0)
    return listed.select("doc_id", "row", "class", F.inline(F.arrays_zip("first", "last", "anchor")))


def edges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(from, to, doc_id, row, at): the edges of the windows that docs' paths (array of first, last) name."""
    schema = "from long, to long, doc_id long, row long, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "row", "paths"))
            for key, row, t, some in zip(ids, rows, texts(batch, "text"), paths):
                at = np.concatenate([np.arange(p["first"], p["last"] + 1) for p in some])
                spans = Spans(word_hashes(t.split()))
                nodes = [spans.of(at + i, at + i + window - 1).view(np.int64) for i in (0, 1)]
                columns = [*nodes, np.full(len(at), key, dtype=np.int64), np.full(len(at), row, dtype=np.int64), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["from", "to", "doc_id", "row", "at"])

    return docs.mapInArrow(run, schema)


def compacted(repeated_edges: DataFrame) -> DataFrame:
    """repeated_edges(from, to, src, n) with the first place `path`, in the source, of the nonbranching path that the edge is on.

    Degrees are counted over the repeated edges. A path goes on over a node with one edge in and one out, as long as its
    source goes on too, so its edges lie side by side in one document and no task gathers more than a document's edges.
    """
    ends = repeated_edges.select(F.col("from").alias("node"), F.lit(0).alias("enter"), F.lit(1).alias("leave"), F.col("to").alias("next")).union(repeated_edges.select("to", F.lit(1), F.lit(0), F.lit(None).cast("long")))
    degrees = ends.groupBy("node").agg(F.sum("enter").alias("enter"), F.sum("leave").alias("leave"), F.max("next").alias("to"))
    # such a node has one edge out, so the join is by the whole edge and no node with many edges is a key
    through = degrees.where("enter = 1 AND leave = 1").select(F.col("node").alias("from"), "to", F.lit(True).alias("through"))
    joined = repeated_edges.join(through, ["from", "to"], "left").select("from", "to", "n", "src.*", F.coalesce("through", F.lit(False)).alias("through"))
    side = Window.partitionBy("doc_id", "row").orderBy("at")
    goes_on = F.col("through") & F.coalesce(F.lag("at").over(side) == F.col("at") - 1, F.lit(False))
    marked = joined.withColumn("start", F.when(~goes_on, F.col("at")))
    path = F.last("start", ignorenulls=True).over(side)
    return marked.select("from", "to", "n", F.col("doc_id").alias("src_id"), F.col("row").alias("src_row"), F.col("at").alias("src_at"), path.alias("path"))


def span_digests(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """wanted(src_id, src_row, src_first, size, n) with the digest of the words at that place of docs(doc_id, row, text)."""
    by_doc = wanted.groupBy(F.col("src_id").alias("doc_id"), F.col("src_row").alias("row")).agg(F.collect_list(F.struct("src_first", "size", "n")).alias("spans"))
    schema = "src_id long, src_row long, src_first int, size int, n long, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "row", "spans"))
            for key, row, t, some in zip(ids, rows, texts(batch, "text"), spans):
                words = t.split()
                found = [_digest(words[s["src_first"] : s["src_first"] + s["size"] + window]) for s in some]
                columns = [pa.array([key] * len(some), pa.int64()), pa.array([row] * len(some), pa.int64()), pa.array([s["src_first"] for s in some], pa.int32()), pa.array([s["size"] for s in some], pa.int32()), pa.array([s["n"] for s in some], pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["src_id", "src_row", "src_first", "size", "n", "digest"])

    return docs.select("doc_id", "row", "text").join(by_doc, ["doc_id", "row"]).mapInArrow(run, schema)


def repeats(docs: DataFrame, profile: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """What repeats in docs(doc_id, row, text) with profiles(docs); doc_id is never null.

    copies(doc_id, row): documents whose words a document with a smaller id has too, all of them, and at least a window.
    spans(doc_id, row, spans): of the others, the windows, as (first, last) starts, that also start in a document with a
    smaller id, each with a digest of the words from the first one's first to the last one's last at their source.
    texts(doc_id, row, text): of all documents with spans, and of some more.
    twins(doc_id, row, of): rows with the words and the id of row `of` of a document, which stands for them in the other
    results; None where all rows' `row` are equal.

    All groups are reduced before they are joined, and keys that many rows have are split, so a passage that many
    documents share is no single task's work.
    """
    key = ["doc_id", "row"]
    long = profile.where(F.col("n_words") >= window)
    classes = written(long.groupBy("same").agg(F.min(F.struct(*key)).alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    member = join_heavy(long.select(*key, "same"), classes, ["same"], ["doc_id", "row"])
    copies = member.where("doc_id > least.doc_id").select(*key).distinct()
    twins = None
    if not docs.where("row <> 0").isEmpty():
        twins = member.where("doc_id = least.doc_id AND row <> least.row").select(*key, F.col("least.row").alias("of")).distinct()
    # anchors of several classes, and those that many rows have
    found = written(anchors(docs, window), "stretches")
    per_anchor = found.groupBy("anchor").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count(F.lit(1)).alias("n"))
    kept = written(per_anchor.where(f"a <> b OR n > {MANY}").select("anchor", F.col("a").eqNullSafe(F.col("b")).alias("own"), "n"), "anchors")
    met = join_heavy(found.drop("class"), kept, ["anchor"], ["doc_id"]).where("NOT own").select(*key, "first", "last")
    of_doc = written(met.join(classes.select("least.*"), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("paths")), "paths")
    near = perhaps_among(docs, of_doc, key).where("_among").drop("_among")
    held = written(near.dropDuplicates(key).join(of_doc, key), "texts")
    graph = edges(held, window)
    shared = graph.groupBy("from", "to").agg(F.min(F.struct(*key, "at")).alias("src"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("src.doc_id < most").drop("most")
    on_paths = written(compacted(written(shared, "repeated")), "compacted")
    runs = join_heavy(graph, on_paths, ["from", "to"], ["doc_id", "at"]).where("doc_id > src_id")
    # a run goes on while it and its path do
    side = Window.partitionBy(*key).orderBy("at")
    before = lambda c: F.lag(c).over(side)
    goes_on = (before("at") + 1 == F.col("at")) & (before("src_at") + 1 == F.col("src_at")) & (before("src_id") == F.col("src_id")) & (before("src_row") == F.col("src_row")) & (before("path") == F.col("path"))
    numbered = runs.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(side))
    spans = written(
        numbered.groupBy(*key, "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("src_id").alias("src_id"), F.min("src_row").alias("src_row"), F.min("src_at").alias("src_first")).withColumn("size", F.col("last") - F.col("first")).drop("run"),
        "runs",
    )
    place = ["src_id", "src_row", "src_first", "size"]
    at_source = written(span_digests(held, spans.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), window), "sources")
    with_words = join_heavy(spans, at_source, place, ["doc_id", "first"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "last", "digest"))).alias("spans"))
    return copies, with_words, held.drop("paths"), twins


def as_twins(results: DataFrame, twins: DataFrame) -> DataFrame:
    """What results(doc_id, row, ...) say of the rows that have twins, for these."""
    return results.withColumnRenamed("row", "of").join(twins, ["doc_id", "of"]).select(results.columns)


def covered(words: list[bytes], spans: list[dict] | None, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that starts in one of the spans; a span whose words differ from their source's counts for nothing."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans or ():
        if _digest(words[s["first"] : s["last"] + window]) == s["digest"]:
            change[s["first"]] += 1
            change[min(len(words), s["last"] + window)] -= 1
    return np.cumsum(change[:-1]) > 0


def row_key(docs: DataFrame) -> tuple[Column, bool]:
    """What tells apart texts that share an id: a hash of the text, or nothing where no id repeats; and whether one does."""
    again = not docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty()
    return F.xxhash64("text") if again else F.lit(0).cast("long"), again


def kept_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of docs(doc_id, text).

    A word goes if it lies in a window of `window` words that also starts in a document with a smaller id; null ids are
    neither smaller nor greater than any. Null texts have no words. Rows that share an id don't count as each other's
    source, but each loses what it shares with smaller ids. Long texts take memory for their words and hashes, some 100 bytes
    a word. An empty table gives no rows.
    """
    rows = docs.select("doc_id", row_key(docs)[0].alias("row"), "text")
    profile = written(profiles(rows), "profiles")
    named = F.col("doc_id").isNotNull()
    copies, spans, held, twins = repeats(rows.where(named), profile.where(named), window)
    fields = [T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            gone, digest = [], []
            for t, s in zip(texts(b, "text"), b.column(b.schema.get_field_index("spans")).to_pylist()):
                words = t.split()
                out = covered(words, s, window).tolist()
                gone.append(sum(out))
                digest.append(hashlib.sha256(b" ".join(w for w, x in zip(words, out) if not x)).hexdigest())
            yield [pa.array(gone, pa.int64()), pa.array(digest, pa.string())]

    changed = with_columns(held.join(spans, ["doc_id", "row"]), "text", fields, fill).select("doc_id", "row", "n_removed", "kept_sha256").distinct()
    if twins is not None:
        changed = written(changed, "changed")
        changed = changed.union(as_twins(changed, twins))
    all_gone = copies.join(profile, ["doc_id", "row"]).select("doc_id", "row", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256")).distinct()
    done = profile.where(named).join(changed.union(all_gone), ["doc_id", "row"], "left").unionByName(profile.where(~named), allowMissingColumns=True)
    return done.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the removed words cut from `text` (the rest is joined by single spaces) and n_chars, if there, counted anew.

    Texts that lose nothing are unchanged, nulls too, and so are rows without an id. Repeated rows lose the same. All other
    columns pass through, whatever their names; an empty table gives no rows.
    """
    row, _ = row_key(docs)
    plain = docs.where(F.col("doc_id").isNotNull()).select("doc_id", row.alias("row"), "text")
    copies, spans, _, twins = repeats(plain, profiles(plain), window)
    if twins is not None:
        spans = spans.unionByName(as_twins(spans, twins))
    lost = spans.withColumn("all", F.lit(False)).unionByName(copies.withColumn("all", F.lit(True)), allowMissingColumns=True)
    changes = written(lost.select("doc_id", "row", "spans", "all"), "changes")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            spans, gone, column = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("spans", "all", "text"))
            new = []
            for t, s, everything in zip(column, spans, gone):
                if everything:
                    t = ""
                elif t is not None and s:
                    words = t.encode().split()
                    out = covered(words, s, window).tolist()
                    if any(out):
                        t = b" ".join(w for w, x in zip(words, out) if not x).decode()
                new.append(t)
            yield [pa.array(new, pa.string())]

    rows = packed(docs, F.col("doc_id"), row.alias("row"))
    asked = perhaps_among(rows, changes, ["doc_id", "row"])
    cut = with_columns(asked.where("_among").join(changes, ["doc_id", "row"], "left"), "text", [T.StructField("text", T.StringType(), True)], fill)
    counted = {}
    if "n_chars" in docs.columns:
        own = F.col(f"{PACKED}.c{docs.columns.index('n_chars')}")
        counted["n_chars"] = F.when(F.col("all").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own)
    return unpacked(asked.where("NOT _among"), docs.columns).union(unpacked(cut, docs.columns, **counted))
