"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .audio import media_digests
from .bpe import bpe_roundtrip, digests, read_ranks
from .common import doc_key, table
from .hyperdim import held_out_languages
from .lm import lm_scores
from .mixing import mix
from .omh import edited_pairs
from .ordinal import select_best
from .periodic import run_digests, with_repeating_tails
from .search import search
from .simhash import near_duplicates
from .substring import kept_digests
from .urls import Rule, judge
from .wordpiece import count_pieces, read_vocabulary

QUERIES: dict = {}
#: The SQL of queries that SQL can express, one file each.
ORACLE: dict[str, str] = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "sql").glob("*.sql"))}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    ranks = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    return digests(bpe_roundtrip(doc_key(table(spark, sf_dir, "documents")), ranks, public.PATTERN))


@query
def op2_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(doc_key(table(spark, sf_dir, "documents")))


@query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(doc_key(table(spark, sf_dir, "documents")))


@query
def op5_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    vocabulary = read_vocabulary(public.path("byte_bpe_multi_50k.tiktoken"))
    return count_pieces(doc_key(table(spark, sf_dir, "documents")), vocabulary).drop("text")


@query
def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(doc_key(table(spark, sf_dir, "documents")))


@query
def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_key(table(spark, sf_dir, "documents"))
    return select_best(docs, table(spark, sf_dir, "labels")).drop("text")


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(table(spark, sf_dir, "documents"))


@query
def op10_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digests(doc_key(table(spark, sf_dir, "documents")))


@query
def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    ranks = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    return lm_scores(doc_key(table(spark, sf_dir, "documents")), (ranks, public.PATTERN))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(with_repeating_tails(doc_key(table(spark, sf_dir, "documents"))))


#: The rules that URLs are judged by.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


@query
def op12_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


@query
def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(doc_key(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
