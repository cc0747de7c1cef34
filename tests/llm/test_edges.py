"""Empty tables, null and repeated ids, null texts, and columns with clashing names."""

from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest

from tidemark.llm.audio import media_digests
from tidemark.llm.bpe import bpe_decode, bpe_encode, digests, read_ranks
from tidemark.llm.common import doc_key
from tidemark.llm.hyperdim import held_out_languages
from tidemark.llm.lm import lm_scores
from tidemark.llm.mixing import mix, mixed
from tidemark.llm.omh import edited_pairs
from tidemark.llm.ordinal import OrdinalModel, rate, select_best
from tidemark.llm.simhash import keep_first, near_duplicates
from tidemark.llm.substring import kept_digests, without_repeats
from tidemark.llm.wordpiece import count_pieces

RANKS = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))

BY_DOC = {
    "bpe": lambda d: digests(bpe_decode(bpe_encode(doc_key(d), RANKS, public.PATTERN), RANKS)),
    "audio": lambda d: media_digests(doc_key(d)),
    "order_minhash": lambda d: edited_pairs(doc_key(d)),
    "simhash": lambda d: near_duplicates(doc_key(d)),
    "pieces": lambda d: count_pieces(d, list(RANKS)),
    "rate": lambda d: rate(d, None),
    "mix": mix,
    "language": lambda d: held_out_languages(d if "lang" in d.columns else d.selectExpr("*", "'en' AS lang")),
    "lm": lambda d: lm_scores(doc_key(d), (RANKS, public.PATTERN)),
    "substring": lambda d: kept_digests(doc_key(d)),
    "cut": without_repeats,
}


@pytest.mark.parametrize("name", BY_DOC)
def test_empty(empty_docs, name):
    assert BY_DOC[name](empty_docs).collect() == []


@pytest.mark.parametrize("name", BY_DOC)
def test_nulls_repeats_and_clashing_names(clashing, name):
    rows = BY_DOC[name](clashing).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 1, None, 2, None, 3])


def test_keep_first(spark, clashing, empty_docs):
    """One row of each group stays: repeated rows, other texts of the same id and copies without an id go too."""
    assert sorted((r["doc_id"], r["text"]) for r in keep_first(clashing).collect()) == [(1, "one two three"), (2, None)]
    assert keep_first(clashing).columns == clashing.columns and keep_first(empty_docs).collect() == []
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = spark.createDataFrame([(1, one), (5, one), (5, other), (None, other), (None, "alone so far"), (None, "alone so far")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in keep_first(rows).collect())) == [(0, "alone so far"), (1, one), (5, other)]


def test_rows_of_one_id_lose_their_repeats_in_any_white_space(spark):
    """Rows that share an id and a text's words, but not its white space, lose what a smaller id has."""
    a = [f"a{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (5, "x " + " ".join(a)), (5, "x  " + "\n".join(a)), (5, "x  " + "\n".join(a)), (7, "y " + " ".join(a)), (7, "z"), (None, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in kept_digests(docs).collect())
    assert got == [(0, 60, 0), (1, 60, 0), (5, 61, 60), (5, 61, 60), (5, 61, 60), (7, 1, 0), (7, 61, 60)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in without_repeats(docs).collect())
    assert kept == [(0, " ".join(a)), (1, " ".join(a)), (5, "x"), (5, "x"), (5, "x"), (7, "y"), (7, "z")]


def test_quality_without_labels(spark, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["keep"] for r in select_best(doc_key(clashing), none).collect())


def test_mixed(clashing, empty_docs):
    assert mixed(empty_docs).collect() == [] and mixed(clashing).columns == clashing.columns


@pytest.mark.parametrize("keeps", [mixed, keep_first, without_repeats])
def test_columns_with_clashing_names_pass_through(clashing, keeps):
    rows, own = keeps(clashing).collect(), clashing.columns[4:]
    assert keeps(clashing).columns == clashing.columns
    assert rows and len(own) > 50 and all(r[c] == f"own {c}" for r in rows for c in own)


def test_values_of_nulls_and_repeats(clashing):
    by = lambda df, c: Counter((r["doc_id"], r["text"] if "text" in df.columns else None, r[c]) for r in df.collect())
    assert by(count_pieces(clashing, list(RANKS)), "n_words") == Counter([(1, "one two three", 3)] * 2 + [(None, "one two three", 3), (2, None, 0), (None, None, 0), (3, "", 0)])
    groups = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in near_duplicates(doc_key(clashing)).collect()}
    empty = "0" * 16
    assert groups[2, empty] == groups[None, empty] == groups[3, empty] == 2 and len({v for (d, _), v in groups.items() if d == 1}) == 1
    model = OrdinalModel(np.zeros(1 << 18, dtype=np.float32), np.array([-1.0, 1.0]))
    rated = rate(clashing, model).collect()
    assert len(rated) == 6 and all(r["tail_prob"] == pytest.approx(1 / (1 + np.e)) and r["expected_grade"] == pytest.approx(1) for r in rated)
    kept = kept_digests(doc_key(clashing)).collect()
    assert all(r["n_removed"] == 0 for r in kept) and {r["n_words"] for r in kept} == {0, 3}
    assert sorted(r["taken"] for r in mix(clashing).collect()) == sorted(r["taken"] for r in mix(clashing.repartition(3)).collect())
