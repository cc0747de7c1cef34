"""Byte-level BPE.

Encoding keeps one row per token position and lets a recursive DuckDB query, run inside each Spark task, contract the
leftmost pair of least rank of every word until none is left. Decoding joins the ids with the vocabulary and
concatenates the pieces by an ordered aggregation. Tasks need no shuffle: a word's merges depend on the word alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memory, with_columns

#: Words whose ids a Python worker remembers in each of two generations. A bound on memory, not on input.
REMEMBERED = 800_000
#: A recursive query keeps every step of its words, at most half the sum of their squared lengths; this bounds the sum, and so DuckDB's memory.
WORK_A_QUERY = 1_000_000
#: Bytes of the pieces that a longer word is first cut into.
PIECE = 96
#: Tokens decoded by one query.
TOKENS_A_QUERY = 100_000
#: What DuckDB may take in each worker.
DUCKDB = {"threads": 1, "memory_limit": "100MB", "temp_directory": ""}

#: Pair keys hold the rank over the pair's position over the next token's position (20 bits each), so that min() finds
#: the leftmost pair of least rank.
CONTRACT = """
WITH RECURSIVE s(w, p, t, q, u, k, step) AS (
  SELECT w, p, t, q, u, (m.rank << 40) | (p::BIGINT << 20) | q, 0 FROM start LEFT JOIN merges m ON m.pair = (t::BIGINT << 17) | u
  UNION ALL
  SELECT w, p, t, q, u, CASE WHEN changed THEN (m.rank << 40) | (p::BIGINT << 20) | q ELSE k END, step + 1
  FROM (
    SELECT s.w, s.p, s.k, s.step,
      CASE WHEN s.k = best.k THEN (best.k >> 40)::INTEGER ELSE s.t END AS t,
      CASE WHEN s.k = best.k THEN other.q ELSE s.q END AS q,
      CASE WHEN s.k = best.k THEN other.u WHEN s.q = ((best.k >> 20) & 1048575)::INTEGER THEN (best.k >> 40)::INTEGER ELSE s.u END AS u,
      s.k IS NOT DISTINCT FROM best.k OR coalesce(s.q = ((best.k >> 20) & 1048575)::INTEGER, false) AS changed
    FROM s
    JOIN (SELECT w, min(k) AS k FROM s GROUP BY w HAVING min(k) IS NOT NULL) best ON s.w = best.w
    JOIN s AS other ON other.w = best.w AND other.p = (best.k & 1048575)::INTEGER
    WHERE s.p <> (best.k & 1048575)::INTEGER
  ) x LEFT JOIN merges m ON m.pair = CASE WHEN changed THEN (x.t::BIGINT << 17) | x.u END
)
SELECT s.w, list(s.t ORDER BY s.p) AS ids
FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) last ON s.w = last.w AND s.step = last.step
GROUP BY s.w
"""

#: For one word that repeats a part endlessly: some steps at a time, the rows of the last step start the next query. A step
#: contracts all places of the pair of least rank, of overlapping ones every other from the left, as one after the other would: a
#: token that a contraction makes has no pair of a lower rank, since what it is made of had none left.
CONTRACT_LONG = """
WITH RECURSIVE s(p, t, r, step) AS (
  SELECT p, t, m.rank, 0 FROM (SELECT p, t, lead(t) OVER (ORDER BY p) AS u FROM start) x LEFT JOIN merges m ON m.pair = (x.t::BIGINT << 17) | x.u
  UNION ALL
  SELECT p, t, m.rank, step + 1
  FROM (
    SELECT p, t, step, lead(t) OVER (ORDER BY p) AS u
    FROM (
      SELECT p, step, CASE WHEN merged THEN least ELSE t END AS t, coalesce(lag(merged) OVER (ORDER BY p), false) AS gone
      FROM (
        SELECT p, t, step, least, here AND row_number() OVER (PARTITION BY run, here ORDER BY p) % 2 = 1 AS merged
        FROM (SELECT *, sum(CASE WHEN here THEN 0 ELSE 1 END) OVER (ORDER BY p) AS run FROM (SELECT p, t, step, b.least, coalesce(r = b.least, false) AS here FROM s, (SELECT min(r) AS least FROM s) b WHERE b.least IS NOT NULL AND s.step < {steps}))
      )
    ) WHERE NOT gone
  ) x LEFT JOIN merges m ON m.pair = (x.t::BIGINT << 17) | x.u
)
SELECT p, t, r FROM s WHERE step = (SELECT max(step) FROM s) ORDER BY p
"""

DECODE = """
SELECT d, array_to_string(list(piece ORDER BY p), '') AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens: base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose concatenation is a token, with that token's rank."""
    pair, rank = [], []
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pair.append(a << 17 | b)
                rank.append(r)
    return pa.table({"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int64())})


#: A fixed value: the pattern for which `Encoder.segments` may cut texts at single white space.
EVEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """One Python worker's connection and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.ranks, self.split, self.even = ranks, regex.compile(pattern).findall, pattern == EVEN_PATTERN
        self.token = {r: t for t, r in ranks.items()}
        #: ids of words that need no contraction
        self.whole = {b"": b""} | {t: np.int32(r).tobytes() for t, r in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.con = duckdb.connect(config=DUCKDB)
        self.con.execute("SET preserve_insertion_order = false")
        self.con.register("merges_", pair_table(ranks))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_")
        #: ids of words, and of segments, in two generations: a word is the only word of the segment that it makes
        self.new_ids: dict[str, bytes] = {}
        self.old_ids: dict[str, bytes] = {}

    #: Two white-space characters side by side.
    UNEVEN = re.compile(r"\s\s")
    #: Segments that are one match of that pattern; of others the pattern has to say so.
    ONE = re.compile(r" ?(?:[A-Za-z]+|[0-9]+)")

    def segments(self, text: str) -> list[str]:
        """Segments whose words, one after the other, are the text's words.

        Where white space is single, no match of that pattern reaches over a space from its left or over a line end.
        """
        if not self.even or "\0" in text or self.UNEVEN.search(text):
            return self.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def merge(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each word's ids; words are contracted together up to the work that a query may take.

        Words of like lengths go together: a query takes as many steps as its longest word does.
        """
        words = list(words)
        coded = list(map(str.encode, words))
        found = list(map(self.whole.get, coded))
        new = np.fromiter((i for i, ids in enumerate(found) if ids is None), dtype=np.int64)
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))[new]
        order = np.argsort(size, kind="stable")
        new, work = new[order].tolist(), size[order] ** 2
        done, i = np.cumsum(work), 0
        while i < len(new) and work[i] <= WORK_A_QUERY:
            j = int(np.searchsorted(done, done[i] - work[i] + WORK_A_QUERY, side="right"))
            for n, ids in zip(new[i:j], self.contract([coded[n] for n in new[i:j]])):
                found[n] = ids
            i = j
        for n in new[i:]:
            found[n] = self.contract_long(coded[n])
        return dict(zip(words, found))

    def contract(self, some: list[bytes]) -> list[bytes]:
        """The ids of some words, none of them empty."""
        size = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        end = np.cumsum(size)
        token = self.of_byte[np.frombuffer(b"".join(some), dtype=np.uint8)]
        pos = (np.arange(len(token)) - np.repeat(end - size, size)).astype(np.int32)
        last = np.zeros(len(token), dtype=bool)
        last[end - 1] = True
        word = np.repeat(np.arange(len(some), dtype=np.int32), size)
        self.con.register("start", pa.table({"w": word, "p": pos, "t": token, "q": pa.array(pos + 1, mask=last), "u": pa.array(np.append(token[1:], np.int32(0)), mask=last)}))
        found = self.con.sql(CONTRACT).to_arrow_table()
        ids = found["ids"].combine_chunks()
        flat, order = ids.values.to_numpy().astype(np.int32).tobytes(), np.argsort(found["w"].to_numpy())
        ends = ids.offsets.to_numpy().astype(np.int64) * 4
        return [flat[a:b] for a, b in zip(ends[:-1][order].tolist(), ends[1:][order].tolist())]

    def contract_long(self, word: bytes) -> bytes:
        """The ids of a word of any length, contracted in pieces.

        Ids are the word's if every two neighbours are the ids of their own bytes. So pieces of PIECE bytes are contracted
        together, and where two of them meet in ids that are not, the ids around are contracted again as one piece, ever
        more of them. Words of one endlessly repeated part never settle so; they are contracted whole, in few steps.
        """
        #: pieces as lists of ids; a piece that is done is joined to the one before it
        cut = [word[i : i + PIECE] for i in range(0, len(word), PIECE)]
        parts = self._ids(cut)
        around = 4
        while len(parts) > 1:
            fits = self._fit([(a[-1], b[0]) for a, b in zip(parts, parts[1:])])
            joined = [list(parts[0])]
            for part, fit in zip(parts[1:], fits):
                if fit:
                    joined[-1].extend(part)
                else:
                    joined.append(list(part))
            if len(joined) == 1:
                parts = joined
                break
            if around > PIECE:
                return self.contract_whole(word)
            # of every second place where parts don't fit, the ids around it are contracted as one piece, so that no two overlap
            again = list(zip(joined, joined[1:]))[::2]
            middle = self._ids([b"".join(self.token[i] for i in (*a[-around:], *b[:around])) for a, b in again])
            parts = []
            for (a, b), m in zip(again, middle):
                parts += [x for x in (a[:-around], list(m), b[around:]) if x]
            if len(joined) % 2:
                parts.append(joined[-1])
            around += 2
        return np.array(parts[0], dtype=np.int32).tobytes()

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces of some hundred bytes."""
        found = {}
        todo: list[bytes] = []
        work = 0
        for x in dict.fromkeys(pieces):
            if (r := self.ranks.get(x)) is not None:
                found[x] = [r]
                continue
            if todo and work + len(x) ** 2 > WORK_A_QUERY:
                found |= {w: np.frombuffer(i, dtype=np.int32).tolist() for w, i in zip(todo, self.contract(todo))}
                todo, work = [], 0
            todo.append(x)
            work += len(x) ** 2
        if todo:
            found |= {w: np.frombuffer(i, dtype=np.int32).tolist() for w, i in zip(todo, self.contract(todo))}
        return [found[x] for x in pieces]

    def _fit(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Are two ids those of their bytes together?"""
        different = sorted(set(pairs))
        got = dict(zip(different, self._ids([self.token[a] + self.token[b] for a, b in different])))
        return [got[p] == list(p) for p in pairs]

    def contract_whole(self, word: bytes) -> bytes:
        now = pa.table({"p": np.arange(len(word), dtype=np.int32), "t": self.of_byte[np.frombuffer(word, dtype=np.uint8)]})
        while True:
            self.con.register("start", now)
            now = self.con.sql(CONTRACT_LONG.format(steps=max(1, WORK_A_QUERY // (2 * now.num_rows)))).to_arrow_table()
            if now["r"].null_count == now.num_rows:
                return now["t"].to_numpy().astype(np.int32).tobytes()

    def encode(self, column: list[str]) -> list[np.ndarray]:
        if len(self.new_ids) > self.remembered:
            self.new_ids, self.old_ids = {}, self.new_ids
        new_ids, old_ids = self.new_ids, self.old_ids
        cut = [self.segments(text) for text in column]
        # set.difference_update() would go over all that is remembered
        new = set().union(*cut).difference(new_ids)
        new_ids.update((s, old_ids[s]) for s in new if s in old_ids)
        new = new.difference(old_ids)
        one = self.ONE.fullmatch if self.even else lambda s: None
        inside = {s: ws for s in new if not one(s) and (ws := self.split(s)) != [s]}
        new_ids.update(self.merge(new.difference(inside).union(*inside.values()).difference(new_ids)))
        for s, ws in inside.items():
            new_ids[s] = b"".join(map(new_ids.__getitem__, ws))
        return [np.frombuffer(b"".join(map(new_ids.__getitem__, segments)), dtype=np.int32) for segments in cut]


class Decoder:
    """One Python worker's connection and vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.con = duckdb.connect(config=DUCKDB)
        # text only can be joined: each byte becomes the character of the same number
        self.con.register("pieces", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM pieces")
        self.known = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.known[list(ranks.values())] = True

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of every list of ids; a query takes TOKENS_A_QUERY ids of one text or several, so a text may have any number."""
        out: list[list[bytes]] = [[] for _ in range(len(ids))]
        flat = ids.flatten().cast(pa.int32()).to_numpy(zero_copy_only=False)
        size = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        for i in range(0, len(flat), TOKENS_A_QUERY):
            x = flat[i : i + TOKENS_A_QUERY]
            if x.min() < 0 or x.max() >= len(self.known) or not self.known[x].all():
                raise ValueError("an id is not in the vocabulary")
            self.con.register("tokens", pa.table({"d": owner[i : i + TOKENS_A_QUERY], "p": np.arange(len(x), dtype=np.int32), "id": x}))
            got = self.con.sql(DECODE).to_arrow_table()
            for d, piece in zip(got["d"].to_pylist(), got["bytes"].to_pylist()):
                out[d].append(piece.encode("latin-1"))
        return [b"".join(pieces) for pieces in out]


def _worker(kind: type, key: tuple, *args):
    """One encoder or decoder of a vocabulary in each Python worker; they go when another operator uses the worker."""
    made = memory(("bpe", key))
    if kind not in made:
        made[kind] = kind(*args)
    return made[kind]


#: Texts encoded at a time, in characters.
CHARS_A_BATCH = 1_000_000


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", remembered: int = REMEMBERED) -> DataFrame:
    """docs with the column `ids` (array<int>): the ids of every whole text, split by `pattern`, without special tokens.

    A null or empty text has no ids. The vocabulary is broadcast: its size is the tokenizer's, whatever the input's.
    Rows are encoded one by one, so repeated rows and keys need nothing special; a column already named `ids` is
    replaced, others pass through. Empty input gives an empty result.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(ranks), hash((frozenset(ranks.items()), pattern, remembered))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            yield [_encoded(b, text, _worker(Encoder, key, shared.value, pattern, remembered))]

    return with_columns(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()), True)], fill)


def _encoded(b: pa.RecordBatch, text: str, coder: Encoder) -> pa.ListArray:
    column = [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]
    done: list[np.ndarray] = []
    i = 0
    while i < len(column):
        j, n = i, 0
        while j < len(column) and (j == i or n + len(column[j]) <= CHARS_A_BATCH):
            n += len(column[j])
            j += 1
        done += coder.encode(column[i:j])
        i = j
    ends = np.cumsum([0, *map(len, done)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(done) if done else np.zeros(0, dtype=np.int32)))


def bpe_roundtrip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", remembered: int = REMEMBERED) -> DataFrame:
    """docs with the ids of every whole text and the bytes that they decode to; bpe_encode and bpe_decode in one pass over the rows."""
    shared, key = docs.sparkSession.sparkContext.broadcast(ranks), hash((frozenset(ranks.items()), pattern, remembered))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            found = _encoded(b, text, _worker(Encoder, key, shared.value, pattern, remembered))
            yield [found, pa.array(_worker(Decoder, key, shared.value).decode(found), pa.binary())]

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()), True), T.StructField(out, T.BinaryType(), True)]
    return with_columns(docs, text, fields, fill)


def bpe_decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column `out` (binary): the bytes of every row's ids. Null ids decode to no bytes; unknown ids fail."""
    shared, key = df.sparkSession.sparkContext.broadcast(ranks), hash(frozenset(ranks.items()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            yield [pa.array(_worker(Decoder, key, shared.value).decode(column), pa.binary())]

    return with_columns(df, ids, [T.StructField(out, T.BinaryType(), True)], fill)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows that have both columns."""
    return df.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
