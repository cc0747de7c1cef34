"""The bit-sliced search beside plain sums and sorts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import search
from tidemark.llm.queries import QUERIES


def plain_terms(text):
    out, word = [], ""
    for c in text or "":
        if ord(c) >= 128 or c.isascii() and c.isalnum():
            word += c.lower() if "A" <= c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def plain_search(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score)."""
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    total, length = len(counts), sum(n for _, _, n in counts)
    holding = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    rows = []
    for item, wanted in asked.items():
        scores = []
        for d, c, n in counts:
            m = 10 + 90 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        rows += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return rows


@pytest.mark.parametrize("size", [1, 63, 64, 200])
def test_slices_add_and_find_the_greatest(size):
    draw = np.random.default_rng(size)
    for top in (1, 5, 1 << 36):
        numbers = draw.integers(0, top, (7, size), endpoint=True) * (draw.random((7, size)) < 0.6)
        total = None
        for row in numbers:
            at = np.flatnonzero(row)
            one = search.Slices.of(at, row[at], size)
            total = total.plus(one) if total else one
        sums, keys = numbers.sum(axis=0), draw.permutation(size)
        for k in (1, 3, 10, 500):
            places, values = total.top(k, keys)
            order = sorted((i for i in range(size) if sums[i]), key=lambda i: (-sums[i], keys[i]))[:k]
            assert sorted(places.tolist()) == sorted(order) and values.tolist() == sums[places].tolist()


def test_op13(spark, sf_dir, docs, tmp_path):
    items = pq.read_table("/root/testdata/sf0.001/benchmark.parquet")
    pq.write_table(pq.read_table(f"{sf_dir}/documents.parquet"), tmp_path / "documents.parquet")
    pq.write_table(items, tmp_path / "benchmark.parquet")
    got = QUERIES["op13_impact_search"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_search([(d["doc_id"], d["text"]) for d in docs], [(r["item_id"], r["text"]) for r in items.to_pylist()]))


def rows(spark, docs, items):
    return search.search(spark.createDataFrame(docs, "doc_id long, text string, score long, rank string"), spark.createDataFrame(items, "item_id long, text string, query int"))


def test_ties_nulls_repeats_and_long_texts(spark):
    draw = random.Random(6)
    letters = [f"t{i}" for i in range(12)]
    docs = [(draw.choice([None, *range(40)]), draw.choice([None, "", "!?", *[" ".join(draw.choices(letters, k=draw.randint(1, 5))) for _ in range(9)]])) for _ in range(300)]
    docs.append((1000, "T1-É t1 " * 50_000))
    items = [(1, "t1 t2, T3"), (1, "t4"), (2, None), (3, "unknown"), (4, "é t1"), (None, "t5 t6")]
    got = rows(spark, [(d, t, 1, "own") for d, t in docs], [(i, t, 7) for i, t in items]).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_search(docs, items), key=key)


def test_small_blocks_and_groups_change_nothing(spark, monkeypatch):
    draw = random.Random(8)
    letters = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(draw.choices(letters, k=20)), 0, "") for i in range(500)]
    items = [(i, " ".join(draw.choices(letters, k=6)), 0) for i in range(12)]
    whole = sorted(map(tuple, rows(spark, docs, items).collect()))
    monkeypatch.setattr(search, "TERMS", 15)
    monkeypatch.setattr(search.best_of_blocks, "__defaults__", (64,))
    assert len(list(search.query_groups(spark.createDataFrame(items, "item_id long, text string, query int"), 15))) > 3
    assert sorted(map(tuple, rows(spark, docs, items).collect())) == whole == sorted(plain_search([d[:2] for d in docs], [i[:2] for i in items]))


def test_empty_tables(spark):
    assert rows(spark, [], [(1, "a", 0)]).collect() == [] and rows(spark, [(1, "a", 0, "")], []).collect() == []
