"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are the runs of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Arrow batches: rows and bytes at most, since texts can be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; long texts make Arrow batches large, so their rows and bytes are bounded here."""
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one set on the context, or, with a local master only, a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if jsc.getCheckpointDir().isEmpty():
        if not path and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return path or jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df: later plans start from files that outlive executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read back; for intermediate results that are read several times."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What this Python worker remembers between batches, by its user.
_memory: dict[object, dict] = {}


def memory(user: object, entries: int = 150_000) -> dict:
    """The worker's memory for one user, emptied once it holds more than `entries`; the memories of all others are dropped.

    Workers are kept for many tasks of many queries, so what one operator remembers must not stay while the next one runs.
    Ask for it once a batch.
    """
    if user not in _memory or len(_memory[user]) > entries:
        _memory.clear()
        _memory[user] = {}
    return _memory[user]


def release() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task should hold no more than it remembers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Keys with more than this part of all rows are split over tasks; there are fewer of them than this number.
HEAVY = 10_000


def join_heavy(left: DataFrame, right: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """left.join(right, on), where right (written, one row a key) says in `n` how many rows of left have each key.

    A key with more than a HEAVY-th of the counted rows is dealt over several tasks by a hash of left's columns `by`.
    Fewer than HEAVY keys can have so many rows, so the list of them, which is broadcast, has a bounded size.
    """
    part = max(1, (right.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / part).cast("int"))
    heavy = right.where(F.col("n") > part).select(*on, parts.alias("_parts"))
    salted = left.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


#: Bits of the map of keys below, and of one of its rows, which bitmap_construct_agg fixes.
MAP_BITS, ROW_BITS = 1 << 25, 1 << 15


def perhaps_among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows with `_among`: false only where the key is surely not in keys.

    The map of hashed keys that is broadcast has 4 MB whatever the input. Where it fills up, more rows say true, which
    costs work and no result.
    """
    spot = F.pmod(F.xxhash64(*on), F.lit(MAP_BITS))
    marks = keys.select(spot.alias("s")).groupBy(F.expr(f"cast(s div {ROW_BITS} AS int)").alias("_part")).agg(F.bitmap_construct_agg(F.expr(f"s % {ROW_BITS}")).alias("_map"))
    placed = rows.withColumn("_spot", spot).withColumn("_part", F.expr(f"cast(_spot div {ROW_BITS} AS int)"))
    byte = f"cast(conv(hex(substring(_map, cast((_spot % {ROW_BITS}) div 8 AS int) + 1, 1)), 16, 10) AS int)"
    joined = placed.join(F.broadcast(marks), "_part", "left")
    return joined.withColumn("_among", F.coalesce(F.expr(f"(shiftright({byte}, cast(_spot % 8 AS int)) & 1) = 1"), F.lit(False))).drop("_spot", "_part", "_map")


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values as UTF-8, nulls as empty."""
    i = batch.schema.get_field_index(column)
    return [b or b"" for b in batch.column(i).cast(pa.binary()).to_pylist()]


def with_columns(
    df: DataFrame, source: str, fields: list[T.StructField], fill: Callable[[Iterator[pa.RecordBatch]], Iterator[list]]
) -> DataFrame:
    """df with new columns computed from the column `source` by Arrow batches; columns of the same names are replaced.

    fill gets the batches and yields, for each, a list of Arrow arrays for `fields`.
    """
    names = [f.name for f in fields]
    kept = df.drop(*names) if source not in names else df.drop(*[n for n in names if n != source])
    keep = [c for c in kept.columns if c not in names]
    schema = T.StructType([kept.schema[c] for c in keep] + fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tee():
            for b in batches:
                held.append(b)
                yield b

        for arrays in fill(tee()):
            b = held.pop(0)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + arrays, names=keep + names)
        release()

    return kept.mapInArrow(run, schema)


#: The one column that rows are packed into while an operator adds its own.
PACKED = "_packed"


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """docs as one struct column PACKED, but for its `text`, beside `columns` made from it; so no name of docs can clash with a helper's."""
    own = F.struct(F.lit(0).alias("none"), *[_quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    return docs.select(*columns, F.col("text"), own.alias(PACKED))


def unpacked(rows: DataFrame, names: list[str], *columns: Column, **instead: Column) -> DataFrame:
    """The columns of packed rows under their names (or those given instead), then `columns`."""
    own = [instead.get(c, F.col("text") if c == "text" else F.col(f"{PACKED}.c{i}")).alias(c) for i, c in enumerate(names)]
    return rows.select(*own, *columns)


def doc_key(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Only the key and the text, so that other columns can't clash with the ones an operator adds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
