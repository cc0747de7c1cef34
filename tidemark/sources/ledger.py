"""Ledgers: readers, the schema, and a ledger derived from order lines.

Inside the engine money is BIGINT paise and time is TIMESTAMP_NTZ plus seconds since the ledger's first day.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .store import materialise

#: Columns of a raw ledger file.
RAW = T.StructType(
    [
        T.StructField("Transaction_ID", T.StringType()),
        T.StructField("Sender_Account", T.StringType()),
        T.StructField("Receiver_Account", T.StringType()),
        T.StructField("Sender_IFSC", T.StringType()),
        T.StructField("Receiver_IFSC", T.StringType()),
        T.StructField("Amount", T.DecimalType(18, 2)),
        T.StructField("Timestamp", T.TimestampNTZType()),
        T.StructField("Payment_Mode", T.StringType()),
        T.StructField("Narration", T.StringType()),
        T.StructField("IP_Address", T.StringType()),
        T.StructField("Device_Type", T.StringType()),
    ]
)
COLUMNS = ["row_id", "transaction_id", "sender_account", "receiver_account", "sender_ifsc", "receiver_ifsc", "amount_paise", "epoch_s", "payment_mode", "narration", "ip_address", "device_type"]
START = "2026-09-15 00:00:00"


def ledger_path(env: str = "LEDGER_PATH", default: str = "data/transactions.csv", root: str | None = None) -> Path:
    """The path in the environment variable, or else the default, relative to root."""
    path = Path(os.environ.get(env) or default)
    return path if path.is_absolute() else Path(root or os.getcwd()) / path


def read_raw(spark: SparkSession, path: str, lossless: bool = False) -> DataFrame:
    """A CSV or Parquet ledger; lossless keeps all CSV columns as text. FileNotFoundError, or ValueError for another format."""
    local = "://" not in path
    if local and not os.path.exists(path):
        raise FileNotFoundError(path)
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.csv(path) if lossless else reader.option("mode", "FAILFAST").schema(RAW).csv(path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"not a CSV or Parquet ledger: {path}")


def is_candidate(spark: SparkSession, path: str, least: int = 5) -> bool:
    """Does the file's header have at least this many ledger columns? Only the schema is read."""
    return len(set(read_raw(spark, path, lossless=True).limit(0).columns) & set(RAW.fieldNames())) >= least


def discover(root: str) -> dict[str, list[str]]:
    """Ledger and label files below root, by name; driver-side, for local folders."""
    files = [p for p in Path(root).rglob("*") if p.suffix in (".csv", ".parquet")]
    labels = [p for p in files if any(w in p.name.lower() for w in ("label", "truth", "answer"))]
    return {"ledgers": sorted(str(p) for p in files if p not in labels), "labels": sorted(map(str, labels))}


def file_digests(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """path, length and sha256 of files of any size. Executors read each file as a stream, `chunk` bytes at a time; no row holds a file. Spark lists no empty files."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem, LocalFileSystem

        for frame in frames:
            found = []
            for name in frame["path"]:
                local = re.match(r"file:/*(/.*)", name, re.S)
                files, at = (LocalFileSystem(), local[1]) if local else FileSystem.from_uri(quote(name, safe=":/@%"))
                digest = hashlib.sha256()
                with files.open_input_stream(at) as f:
                    while block := f.read(chunk):
                        digest.update(block)
                found.append(digest.hexdigest())
            yield frame.assign(sha256=found)

    return listed.repartition(max(1, min(1000, listed.count())), "path").mapInPandas(run, "path string, length long, sha256 string")


#: Bits of monotonically_increasing_id that count a partition's rows.
_PLACE = 33


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `row_id`: 0, 1, … by the order columns, which are a unique key; nulls come first. No task sorts all rows.

    Rows are dealt by ranges of the order columns, whose bounds Spark draws from the data, sorted there and written once,
    with their places; a range's rows are numbered from the count of those before it.
    """
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # within a range the ids count its sorted rows; their upper bits number the ranges
    dealt = materialise(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    at = F.shiftrightunsigned("_id", _PLACE)
    counts = dealt.groupBy(at.alias("_range")).count()
    before = counts.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # as many rows as ranges
    place = F.col("_id").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return dealt.withColumn("_range", at).join(F.broadcast(before), "_range").withColumn("row_id", (F.col("_before") + place).cast("long")).drop("_range", "_before", "_id")


def from_raw(raw: DataFrame, start: str = START) -> DataFrame:
    """The engine's ledger from a raw one. row_id follows time and ids, since a distributed file has no row order."""
    seconds = F.expr(f"unix_seconds(cast(Timestamp as timestamp)) - unix_seconds(timestamp'{start}')")
    named = raw.select(
        F.col("Transaction_ID").alias("transaction_id"),
        F.col("Sender_Account").alias("sender_account"),
        F.col("Receiver_Account").alias("receiver_account"),
        F.col("Sender_IFSC").alias("sender_ifsc"),
        F.col("Receiver_IFSC").alias("receiver_ifsc"),
        F.round(F.col("Amount") * 100).cast("long").alias("amount_paise"),
        seconds.cast("long").alias("epoch_s"),
        F.col("Payment_Mode").alias("payment_mode"),
        F.col("Narration").alias("narration"),
        F.col("IP_Address").alias("ip_address"),
        F.col("Device_Type").alias("device_type"),
    )
    order = ["epoch_s", "transaction_id", "sender_account", "receiver_account", "amount_paise"]
    return numbered(named, order).select(*COLUMNS)


def with_ts(ledger: DataFrame, start: str = START) -> DataFrame:
    return ledger.withColumn("ts", F.expr(f"timestampadd(SECOND, epoch_s, TIMESTAMP_NTZ'{start}')"))


def derive_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger with planted patterns, from lineitem, orders and customer (no table of transfers exists there)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    accounts = read("customer").agg(F.greatest(F.lit(20), F.floor(F.count(F.lit(1)) / 2)).cast("long").alias("n"))
    line = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    lines = read("lineitem").select(*line, "l_returnflag", "l_linestatus").join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = numbered(lines, line).withColumnRenamed("row_id", "rid").crossJoin(F.broadcast(accounts))
    n, div = F.col("n"), lambda a, b: F.floor(a / b).cast("long")
    s0, r0 = F.col("o_custkey") % n, (F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % n
    base = rows.select(
        "rid", "n", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        div(F.round(F.col("l_extendedprice") * 100).cast("long"), 20).alias("paise"),
        ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31 + F.col("l_suppkey") * 101 + F.col("l_linenumber") * 1009) % 1294000).alias("ep"),
        F.when((s0 % 25 == 3) | (s0 % 50 == 13), s0 - 1).otherwise(s0).alias("s"),
        F.when(r0 % 25 == 7, r0 - 1).otherwise(r0).alias("r"),
    )
    # each row, and where its receiver passes money on, the forward
    own = F.struct((F.col("rid") * 2).alias("row_id"), F.col("paise"), F.col("ep"), F.lit(0).alias("gen"), F.col("s"), F.col("r"))
    sink = (div(F.col("rid") % (n - 4), 25) * 25 + 3).alias("r")
    onward = F.struct((F.col("rid") * 2 + 1).alias("row_id"), div(F.col("paise") * 97, 100).alias("paise"), (F.col("ep") + 180 + F.col("ep") % 720).alias("ep"), F.lit(1).alias("gen"), F.col("r").alias("s"), sink)
    both = F.when(F.col("r") % 50 == 13, F.array(own, onward)).otherwise(F.array(own))
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    u = base.select(*keep, F.inline(both))
    text = lambda head, x, width: F.concat(F.lit(head), F.lpad(x.cast("string"), width, "0"))
    s, r, part = F.col("s"), F.col("r"), F.col("l_partkey") % 100
    mix = (F.col("l_partkey") + F.col("l_suppkey")) % 3
    last = F.when(s % 40 == 11, F.lit(1)).otherwise(F.col("l_suppkey") % 9)
    return u.select(
        "row_id",
        text("TXN", F.col("l_orderkey") * 10 + F.col("l_linenumber"), 9).alias("transaction_id"),
        text("ACC", s, 8).alias("sender_account"),
        text("ACC", r, 8).alias("receiver_account"),
        text("BANK0", s % 97, 6).alias("sender_ifsc"),
        text("BANK0", r % 97, 6).alias("receiver_ifsc"),
        F.col("paise").alias("amount_paise"),
        F.col("ep").alias("epoch_s"),
        F.when(part < 65, "UPI").when(part < 87, "IMPS").when(part < 97, "NEFT").otherwise("RTGS").alias("payment_mode"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "").otherwise(F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))).alias("narration"),
        F.concat_ws(".", F.lit("185"), (s % 200).cast("string"), last.cast("string"), (s % 250).cast("string")).alias("ip_address"),
        F.when((F.col("gen") == 1) & (s % 100 == 13), "Linux_Script").when(s % 40 == 11, "Web_Emulator").when(mix == 0, "Android").when(mix == 1, "iOS").otherwise("Windows_Browser").alias("device_type"),
    )


def entity_view(ledger: DataFrame) -> DataFrame:
    """Each transfer twice, once for either party: one scan, two rows."""

    def side(acc: str, cp: str, ifsc: str, out: int) -> Column:
        return F.struct(F.col(acc).alias("acc"), F.col(cp).alias("cp"), F.col(ifsc).alias("ifsc"), F.lit(out).alias("is_out"), F.lit(1 - out).alias("is_in"))

    sides = F.array(side("sender_account", "receiver_account", "sender_ifsc", 1), side("receiver_account", "sender_account", "receiver_ifsc", 0))
    return ledger.select("row_id", "transaction_id", "amount_paise", "epoch_s", "payment_mode", "narration", "ip_address", "device_type", F.inline(sides))
