"""Runs on the harmonic grid beside a plain search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic
from tidemark.llm.common import doc_key
from tidemark.llm.queries import QUERIES


def plain_runs(words, least=12):
    """Every period's stretches; a stretch that several periods have belongs to the least."""
    n, found = len(words), {}
    codes = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if n else np.zeros(0)
    for p in range(1, n // 2 + 1):
        same = np.concatenate([[False], codes[:-p] == codes[p:], [False]])
        ends = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(ends[::2].tolist(), ends[1::2].tolist()):
            if end - start + p >= max(2 * p, least):
                found.setdefault((start, end - start + p), p)
    return sorted(((s, size, p) for (s, size), p in found.items()), key=lambda r: (r[0], r[2]))


def repeated(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def plain_row(text, doc_id):
    words = repeated((text or "").encode().split(), doc_id)
    runs = plain_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *longest, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_runs_are_those_of_all_periods(letters):
    draw = random.Random(letters)
    for _ in range(150):
        documents = []
        for _ in range(draw.randint(1, 6)):
            words = [b"%d" % draw.randrange(letters) for _ in range(draw.randint(0, 90))]
            if words and draw.random() < 0.5:
                a = draw.randrange(len(words))
                p = 1 + (len(words) - a) // draw.randint(3, 10)
                words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
            documents.append(words)
        for words, runs in zip(documents, periodic._runs_of(documents, 12)):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(words)


def test_small_parts_of_the_grid_change_nothing(monkeypatch):
    draw = random.Random(1)
    documents = [[b"%d" % draw.randrange(2) for _ in range(200)] for _ in range(3)]
    whole = [r.tolist() for r in periodic._runs_of(documents, 12)]
    monkeypatch.setattr(periodic, "PAIRS", 50)
    assert [r.tolist() for r in periodic._runs_of(documents, 12)] == whole and any(whole)


def test_common_prefixes_and_least_values():
    draw = np.random.default_rng(2)
    symbols = draw.integers(0, 2, 300)
    shared = periodic.CommonPrefix(symbols)
    a, b = draw.integers(0, 300, 2000), draw.integers(0, 300, 2000)
    a, b = a[a != b], b[a != b]
    expected = []
    for x, y in zip(a.tolist(), b.tolist()):
        n = 0
        while max(x, y) + n < 300 and symbols[x + n] == symbols[y + n]:
            n += 1
        expected.append(n)
    assert shared.of(a, b).tolist() == expected
    values = draw.integers(0, 1000, 500).astype(np.int32)
    low, high = np.sort(draw.integers(0, 500, (2, 3000)), axis=0)
    assert periodic.LeastBetween(values).of(low, high).tolist() == [values[i : j + 1].min() for i, j in zip(low, high)]


def test_op11(spark, sf_dir, docs):
    rows = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d["doc_id"]] == plain_row(d["text"], d["doc_id"]), d["doc_id"]
    assert sum(r[0] > 0 for r in rows.values()) > len(docs) // 20


def test_runs_keep_rows_and_columns(spark, clashing, empty_docs):
    found = periodic.periodic_runs(clashing)
    assert set(found.columns) == {*clashing.columns, "runs", "collapsed"} and found.count() == clashing.count()
    assert all(r["fp"] == "own fp" and r["runs"] == [] for r in found.collect())
    assert periodic.run_digests(periodic.with_repeating_tails(doc_key(empty_docs))).collect() == []
    rows = periodic.run_digests(periodic.with_repeating_tails(doc_key(clashing))).collect()
    assert len(rows) == 6 and all(r["n_runs"] == 0 and r["start"] is None for r in rows)


def test_a_very_long_text_of_one_word(spark):
    text = "again " * 100_000 + "end"
    (row,) = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 100_000, 1)] and row["collapsed"] == "again end"
