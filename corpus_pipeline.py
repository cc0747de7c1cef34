"""A corpus pipeline of five stages; each gets what the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_roundtrip, read_ranks
from tidemark.llm.common import table, written
from tidemark.llm.mixing import mixed
from tidemark.llm.ordinal import label_grades, rate, train
from tidemark.llm.simhash import keep_first
from tidemark.llm.substring import without_repeats

#: The least probability of the best grade with which a document stays.
LEAST_TAIL = 0.5
#: Words whose ids a worker remembers in the last stage, when the stages before have left the executors little memory.
REMEMBERED = 60_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates documents by a model of the labels; those whose best grade is improbable go. Without labels all stay.

    Null texts are rated as empty ones. Columns of any name pass through; an empty table gives no rows.
    """
    model = train(docs, label_grades(table(spark, sf_dir, "labels")))
    rated = rate(docs, model, names=("_expected", "_sound", "_tail"))
    return rated.where(F.coalesce(F.col("_tail") >= LEAST_TAIL, F.lit(True))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of SimHash near-duplicates; see keep_first for nulls, repeats and clashes."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words of windows that repeat an earlier document's; see without_repeats for nulls, repeats and clashes."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; null and empty texts have no words and are not taken."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with its id and source, and a digest of the bytes that the ids decode to.

    Null texts have no ids; only the three columns are read; an empty table gives no rows.
    """
    import public_tokenizers as public

    ranks = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe_roundtrip(docs.select("doc_id", "source", "text"), ranks, public.PATTERN, remembered=REMEMBERED)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("tokens", tokens)]

#: No stage but the mix could be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
