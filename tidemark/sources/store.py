"""Tiers of the account store, written as Parquet in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir, or with a local master only one temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path or not given.isEmpty():
        return (path or given.get()).rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tiers-"))
    return _local[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written and read back: later plans start from its files, and executors may be lost."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def layout(df: DataFrame, path: str, key: str, partitions: int) -> None:
    """df written sorted by a key, so that row groups can be skipped where one key is looked up."""
    df.repartitionByRange(partitions, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class PartyStore:
    """A ledger laid out for lookups: a bucketed table with a row for each transfer and party, and Bloom filters on transfer ids.

    A lookup by account reads the account's bucket, one by id the row groups whose filter may have it.
    """

    spark: SparkSession
    table: str
    columns: tuple[str, ...]

    def of(self, *accounts: str) -> DataFrame:
        """The transfers of which one of the accounts is a party, each once."""
        own = self.spark.table(self.table).where(F.col("acc").isin(list(accounts)))
        if len(accounts) > 1:  # those between two of them have a row for either
            other = F.col("acc") == F.col("receiver_account")
            own = own.where(F.col("first") | (other & ~F.coalesce(F.col("sender_account").isin(list(accounts)), F.lit(False))))
        return own.select(*self.columns)

    def by_id(self, transaction_id: str) -> DataFrame:
        """The transfers with that id."""
        return self.spark.table(self.table).where((F.col("transaction_id") == transaction_id) & F.col("first")).select(*self.columns)

    def all(self) -> DataFrame:
        """The whole ledger, from the rows of senders (or of receivers where there is no sender)."""
        return self.spark.table(self.table).where("first").select(*self.columns)


def party_store(ledger: DataFrame, rows_a_bucket: int = 1_000_000) -> PartyStore:
    """ledger written as a PartyStore in the shared folder, with as many buckets as its rows ask for.

    Rows are dealt by account into as many parts as buckets, so that a bucket's rows lie in one file, and large shares of a
    hub are split (rebalance), so that no task writes a hub alone; within files they lie by account and time. Transfers
    without any party are left out, as no lookup could ask for them by account.
    """
    spark = ledger.sparkSession
    side = lambda acc, first: F.struct(F.col(acc).alias("acc"), first.alias("first"))
    sender, receiver = side("sender_account", F.lit(True)), side("receiver_account", F.col("sender_account").isNull())
    alone = F.col("receiver_account").isNull() | F.coalesce(F.col("sender_account") == F.col("receiver_account"), F.lit(False))
    parties = F.when(alone, F.array(sender)).otherwise(F.array(sender, receiver))
    count = 2 * ledger.count()
    buckets = max(1, -(-count // rows_a_bucket))
    rows = ledger.select("*", F.inline(parties)).where("acc IS NOT NULL").hint("rebalance", buckets, "acc")
    name = f"party_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "acc").sortBy("acc", "epoch_s", "row_id")
    writer = writer.option("compression", "zstd").option("parquet.bloom.filter.enabled#transaction_id", "true").option("parquet.bloom.filter.expected.ndv#transaction_id", str(max(1, min(count, rows_a_bucket))))
    writer.saveAsTable(name)
    return PartyStore(spark, name, tuple(ledger.columns))


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
