"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector is the product of its letters' vectors, permuted by
place; a text's is the sum of its trigrams' vectors, a language's the sum over its texts. A text is given the language
whose vector has the greatest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

#: Trigram vectors that a Python worker keeps; a bound on memory only.
KEPT = 40_000


@dataclass(frozen=True)
class Space:
    dimensions: int = 1024
    seed: int = 5


@dataclass
class Bundler:
    """One worker's letters and trigrams."""

    space: Space
    rows: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.table = np.empty((KEPT, self.space.dimensions), dtype=np.int8)
        self.order = np.random.default_rng(self.space.seed).permutation(self.space.dimensions)
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([self.space.seed, code]).integers(0, 2, self.space.dimensions, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def trigrams(self, text: str) -> np.ndarray:
        """Packed trigrams of lower-case letters, where each run of other characters is one blank; none without a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own = self.is_letter[codes]
        if not own.any():
            return np.zeros(0, dtype=np.uint64)
        codes, own = np.concatenate([[32], np.where(own, codes, 32), [32]]).astype(np.uint64), np.concatenate([[False], own, [False]])
        codes = codes[np.concatenate([[True], own[1:] | own[:-1]])]
        return codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]

    def bundle(self, trigrams: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors; whole numbers, so any order of adding gives the same."""
        keys, counts = np.unique(trigrams, return_counts=True)
        total = np.zeros(self.space.dimensions, dtype=np.float64)
        for i in range(0, len(keys), 4096):
            at = self._rows(keys[i : i + 4096].tolist())
            total += counts[i : i + 4096].astype(np.float32) @ self.table[at].astype(np.float32) if counts.max() < 1 << 12 else counts[i : i + 4096].astype(np.float64) @ self.table[at].astype(np.float64)
        return total

    def _rows(self, keys: list[int]) -> list[int]:
        try:
            return [self.rows[k] for k in keys]
        except KeyError:
            pass
        if len(self.rows) + len(keys) > KEPT:
            self.rows.clear()
        mask = (1 << 21) - 1
        for k in keys:
            if k not in self.rows:
                a, b, c = self.letter(k >> 42), self.letter(k >> 21 & mask), self.letter(k & mask)
                self.table[len(self.rows)] = a[self.order][self.order] * b[self.order] * c
                self.rows[k] = len(self.rows)
        return [self.rows[k] for k in keys]


_bundlers: dict[Space, Bundler] = {}


def _bundler(space: Space) -> Bundler:
    if space not in _bundlers:
        _bundlers[space] = Bundler(space)
    return _bundlers[space]


def learn(docs: DataFrame, space: Space = Space(), text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The unit vector of each language over all rows of docs that have one; null, empty and letterless texts add nothing.

    Each task bundles its texts and returns a vector a language; vectors are added by dimension, and one for each
    language reaches the driver.
    """
    size = space.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, total = _bundler(space), {}
        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(name, []).append(bundler.trigrams(t))
            for name, some in found.items():
                total[name] = total.get(name, np.zeros(size)) + bundler.bundle(np.concatenate(some))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), text)
    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        sums.setdefault(r["lang"], np.zeros(size))[r["i"]] = r["x"]
    return {k: v / n for k, v in sorted(sums.items()) if (n := np.sqrt(v @ v))}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], space: Space = Space(), text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the cosine with that language's vector (0 if it is negative).

    `und` and 0 for null texts, texts without a letter, and where nothing was learned; of equal cosines the first
    language in code point order wins. Whole texts of any length; columns of these names are replaced.
    """
    names = sorted(profiles)
    shared = docs.sparkSession.sparkContext.broadcast(np.array([profiles[n] for n in names], dtype=np.float64).reshape(len(names), space.dimensions))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        bundler = _bundler(space)
        for b in batches:
            lang, score = [], []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                grams = bundler.trigrams(t or "")
                v = bundler.bundle(grams)
                norm = np.sqrt(v @ v)
                if not len(grams) or not names or not norm:
                    lang.append("und")
                    score.append(0.0)
                    continue
                cosine = shared.value @ v / norm
                best = int(cosine.argmax())
                lang.append(names[best])
                score.append(float(min(1.0, max(0.0, cosine[best]))))
            yield [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return with_columns(docs, text, [T.StructField("lang_pred", T.StringType(), True), T.StructField("score", T.DoubleType(), True)], fill)


def fold(folds: int, which: int, id_col: str = "doc_id") -> Column:
    """Is crc32 of the id's decimal text this remainder? False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == which, F.lit(False))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; the profiles learn from the documents that aren't held out.

    Null ids are not held out; rows of one id are all in the same part; null languages teach nothing; null and letterless
    texts are `und`. Texts are whole, of any length; columns other than doc_id, text and lang are not read; an empty table
    gives no rows. One vector for each language that occurs reaches the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang").withColumn("held_out", fold(4, 2))
    profiles = learn(rows.where(~F.col("held_out")))
    return identify(rows.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
