"""The layout for lookups: what a lookup reads, and that it finds what a scan finds."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.plans import explore, queries
from tidemark.sources import ledger as source
from tidemark.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def laid_out(spark):
    rows = queries.ledger(spark, SF)
    odd = [(10_000_000, "TXN000000011", "A", "A"), (10_000_001, "X", None, "A"), (10_000_002, "Y", "A", None), (10_000_003, "Z", None, None)]
    more = spark.createDataFrame(odd, "row_id long, transaction_id string, sender_account string, receiver_account string")
    ledger = store.materialise(rows.unionByName(more, allowMissingColumns=True), "odd")
    return ledger, store.party_store(ledger, rows_a_bucket=1_500)


def scan(df):
    execution = df._jdf.queryExecution()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return execution.executedPlan().collectLeaves().head(), execution.explainString(mode)


def rows(df):
    return sorted(r["row_id"] for r in df.collect())


def test_an_account_reads_its_bucket_alone(spark, laid_out):
    ledger, parties = laid_out
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {parties.table}").where("col_name = 'Num Buckets'").first()["data_type"])
    assert buckets >= 8
    for account in (queries.HUB, queries.THROUGH, "A", "nobody"):
        own = parties.of(account)
        assert rows(own) == rows(ledger.where(explore.party(account)))
        files = [r[0] for r in own.select(F.input_file_name()).distinct().collect()]
        assert len({re.search(r"_(\d{5})\.", f)[1] for f in files}) <= 1
    rows_of = spark.table(parties.table).groupBy(F.regexp_extract(F.input_file_name(), r"_(\d{5})\.", 1).alias("bucket")).count()
    most = rows_of.agg(F.max("count")).first()[0]
    own = spark.table(parties.table).where(F.col("acc") == queries.THROUGH)
    own.collect()
    assert scan(own)[0].metrics().apply("numOutputRows").value() <= most < ledger.count()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # which leaves the count out of plans
    try:
        assert f"SelectedBucketsCount: 1 out of {buckets}" in scan(parties.of(queries.HUB))[1]
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_several_accounts_have_each_transfer_once(laid_out):
    ledger, parties = laid_out
    names = [r[0] for r in ledger.select("sender_account").where("sender_account IS NOT NULL").distinct().orderBy("sender_account").limit(9).collect()]
    either = ledger.where(F.col("sender_account").isin(names) | F.col("receiver_account").isin(names))
    assert rows(parties.of(*names)) == rows(either)
    assert rows(parties.all()) == rows(ledger.where("row_id <> 10000003"))


def test_an_unknown_id_reads_no_rows(spark, laid_out):
    """Ids that lie between others are told apart by the Bloom filters of the row groups alone."""
    ledger, parties = laid_out
    assert rows(parties.by_id(queries.TX)) == rows(ledger.where(F.col("transaction_id") == queries.TX))
    known = {r[0] for r in ledger.select("transaction_id").distinct().collect()}
    draw = random.Random(3)
    absent = next(t for t in iter(lambda: f"TXN{draw.randrange(20, 40_000):09d}", None) if t not in known)
    found = parties.by_id(absent)
    assert found.collect() == [] and "EqualTo(transaction_id" in scan(found)[1]
    read = spark.table(parties.table).where(F.col("transaction_id") == absent)
    read.collect()
    assert scan(read)[0].metrics().apply("numOutputRows").value() < ledger.count() / 4


def test_traces_over_the_layout_are_those_of_a_scan(laid_out):
    ledger, parties = laid_out
    key = lambda df: sorted(map(str, df.collect()))
    assert key(graph.attribution_trace(ledger, queries.THROUGH, lookup=parties.of)) == key(graph.attribution_trace(ledger, queries.THROUGH))


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_files_are_digested_in_streams(spark, tmp_path, chunk):
    sizes = {"a b.bin": 3_000, "c.bin": 1}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(random.Random(n).randbytes(n))
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")  # a file as one row would fail
    try:
        got = {r["path"].rpartition("/")[2].replace("%20", " "): (r["length"], r["sha256"]) for r in source.file_digests(spark, str(tmp_path), chunk).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert got == {name: (n, hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()) for name, n in sizes.items()}


def test_a_bucket_is_one_file(spark, laid_out):
    """As many files as buckets, each with its own Bloom filters, and not one for each task and bucket."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parties = store.party_store(laid_out[0], rows_a_bucket=1_500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {parties.table}").where("col_name = 'Num Buckets'").first()["data_type"])
    assert len(spark.table(parties.table).inputFiles()) <= buckets
