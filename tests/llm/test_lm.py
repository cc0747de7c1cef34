"""The language model: plain versions of its parts, and that it learns from whole texts."""

import itertools
import math

import numpy as np
import public_tokenizers as public
import pytest

from tidemark.llm import lm
from tidemark.llm.bpe import read_ranks

RANKS = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
TOKENIZER = (RANKS, public.PATTERN)
#: Single bytes and a few longer tokens.
TOY = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate((b" a", b" b", b"ab", b"ba", b" ab"))}
SIZE = max(TOY.values()) + 2


def trained_shares(spark, counts: dict[str, int]) -> lm.WordShares:
    words = spark.createDataFrame([(w.encode(), c) for w, c in counts.items()], "word binary, c long")
    return lm.word_shares(words, 7, (TOY, public.PATTERN))


def random_weights(seed: int = 3, size: int = 40) -> dict:
    draw = np.random.default_rng(seed)
    w = lm.start_weights(size, np.full(lm.CLASSES, 1 / lm.CLASSES))
    return {k: (v + draw.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in w.items()}


def test_words_and_the_end_have_a_probability_of_one_at_most(spark):
    counts = {"a": 5, "b": 3, "ab": 4, "abab": 1, "bba": 1, "aab": 2}
    shares, coder = trained_shares(spark, counts), lm.subwords((TOY, public.PATTERN))
    by_first: dict[int, float] = {}
    for n in range(1, 11):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            ids = coder.ids(word.encode())
            p = shares.given_first(*lm._flat(coder, [word.encode()]), np.array([counts.get(word, 0)]))[0]
            assert p > 0
            by_first[ids[0]] = by_first.get(ids[0], 0.0) + p
    assert all(p <= 1 + 1e-9 for p in by_first.values()) and max(by_first.values()) > 0.75
    model = lm.LanguageModel(random_weights(size=SIZE), np.arange(SIZE) % lm.CLASSES, *[np.empty(0)] * 2)
    counted = np.arange(SIZE) + 1.0
    in_class = np.bincount(model.classes, counted, minlength=lm.CLASSES)
    model = lm.LanguageModel(model.weights, model.classes, counted / in_class[model.classes], counted / counted.sum())
    before = [3, 260, 258]
    total = sum(10 ** model.id_scores(np.array([*before, i, SIZE - 1]), np.array([5]))[3] for i in range(SIZE))
    assert total == pytest.approx(1, abs=1e-4)


def test_scores_are_those_of_a_plain_attention_over_each_window():
    w, size = random_weights(), 40
    classes = np.random.default_rng(1).integers(0, lm.CLASSES, size)
    within, plain = np.full(size, 0.25), np.full(size, 1 / size)
    model = lm.LanguageModel(w, classes, within, plain)
    ids, sizes = np.random.default_rng(2).integers(0, size, 100), np.array([70, 1, 29])
    ids[np.cumsum(sizes) - 1] = size - 1
    got, d = model.id_scores(ids, sizes), lm.WIDTH
    step = lm.WINDOW - lm.OVERLAP
    for begin, n in zip(np.cumsum(sizes) - sizes, sizes):
        read = [size - 1, *ids[begin : begin + n - 1]]
        for i in range(n):
            # the last window that begins early enough: later ones score what comes after their overlap
            at = 0 if i < lm.WINDOW else ((i - lm.OVERLAP) // step) * step
            e = [w["E"][x].astype(float) + w["P"][j] for j, x in enumerate(read[at : at + lm.WINDOW])][: i - at + 1]
            q, k, v = (np.array(e) @ w["A"].astype(float)[:, part * d : part * d + d] for part in range(3))
            a = np.exp(k @ q[-1] / math.sqrt(d))
            h = e[-1] + (a / a.sum()) @ v @ w["O"].astype(float)
            z = np.exp(h @ w["U"].astype(float) + w["c"])
            p = z[classes[ids[begin + i]]] / z.sum()
            assert got[begin + i] == pytest.approx(math.log10((1 - lm.SHARE) * p * 0.25 + lm.SHARE / size), abs=2e-3)


def test_gradients_are_those_of_small_changes():
    w = {k: v.astype(np.float64) for k, v in random_weights().items()}
    draw = np.random.default_rng(5)
    x, y, use = draw.integers(0, 40, (3, 9)), draw.integers(0, lm.CLASSES, (3, 9)), draw.random((3, 9)) < 0.8
    _, g, de = lm.gradients(w, x, y, use)
    by_id = np.zeros_like(w["E"])
    np.add.at(by_id, x.reshape(-1), de)
    for k in (*lm.DENSE, "E"):
        own = by_id if k == "E" else g[k]
        at = tuple(np.array(np.nonzero(np.abs(own) > np.abs(own).max() / 3))[:, 0])
        more, less = ({**w, k: w[k].copy()} for _ in range(2))
        more[k][at] += 1e-3
        less[k][at] -= 1e-3
        change = (lm.gradients(more, x, y, use)[0] - lm.gradients(less, x, y, use)[0]) / 2e-3
        assert own[at] == pytest.approx(change, rel=0.05, abs=1e-4), k


def test_neighbours_are_gathered_from_whole_texts(spark):
    rows = [(1, list(range(40)) * 3 + [49]), (2, [5, 5, 7, 49]), (3, [49])]
    code, size = lm.codes(50), 50
    expected = np.zeros((size, lm.NEAR), dtype=np.int64)
    for _, ids in rows:
        for i, one in enumerate(ids):
            for j in range(max(0, i - lm.SIDE), min(len(ids), i + lm.SIDE + 1)):
                if j != i:
                    expected[one] += code[ids[j]]
    got = lm.neighbours(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2), size)
    assert np.array_equal(got, expected)
    total, pieces = np.zeros_like(expected), np.zeros_like(expected)
    row = np.array([5, 6, 7, 5] * 9)
    lm.add_neighbours(total, code, row, np.array([20, 16]))
    lm.add_neighbours(pieces, code, row, np.array([20, 16]), at_once=3)
    assert np.array_equal(total, pieces)


def test_whole_texts_train_the_weights(spark):
    ids = [int(x) for x in np.random.default_rng(1).integers(0, 99, 400)]
    classes, start = np.arange(100) % lm.CLASSES, lm.start_weights(100, np.full(lm.CLASSES, 1 / lm.CLASSES))

    def trained(text):
        return lm.one_round(spark.createDataFrame([([*text, 99],)], "ids array<int>").coalesce(1), classes, start)

    one, first, last = (trained(t) for t in (ids, [50, *ids[1:]], [*ids[:-1], 50]))
    for changed in (first, last):
        assert any(not np.array_equal(one[k], changed[k]) for k in one)


def test_every_place_of_a_stream_is_a_target_once(monkeypatch):
    sizes, seen = np.array([2, 49, 50, 300, 0]), []
    monkeypatch.setattr(lm.Descent, "step", lambda self, x, y, use: seen.extend(y[use].tolist()))
    ids = np.arange(sizes.sum())
    _, n = lm.train_on_stream(lm.start_weights(500, np.full(lm.CLASSES, 1 / lm.CLASSES)), [(ids, sizes), (ids, sizes)], ids)
    assert sorted(seen) == sorted(2 * ids.tolist()) and n == 2 * len(ids)


def test_a_trained_model_knows_more_than_the_words_counts(spark):
    """Two kinds of text with words of their own: on held-out texts the model is better than the base."""
    draw = np.random.default_rng(8)
    kinds = [[f"{a}{b}" for a in head for b in ("ka", "lo", "mi", "ne", "ru", "so", "ti", "vu")] for head in (("ba", "de", "fi"), ("go", "hu", "ja"))]
    rows = [(i, " ".join(draw.choice(kinds[i % 2], 60))) for i in range(400)]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), TOKENIZER).where("held_out").collect()
    assert len(got) > 40 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def toy_model(seed: int = 3) -> lm.LanguageModel:
    begins = np.zeros(SIZE, dtype=bool)
    begins[[r for t, r in TOY.items() if t.startswith(b" ")] + [SIZE - 1]] = True
    counts = np.random.default_rng(seed).integers(0, 9, SIZE).astype(float)
    classes = lm.class_table(np.random.default_rng(seed).standard_normal((SIZE, lm.NEAR)), counts, begins)
    assert not set(classes[begins]) & set(classes[~begins])
    in_class = np.bincount(classes, counts + 0.5, minlength=lm.CLASSES)
    return lm.LanguageModel(random_weights(size=SIZE), classes, (counts + 0.5) / in_class[classes], (counts + 0.5) / (counts + 0.5).sum(), begins)


def test_all_ids_of_whole_texts_are_read_and_predicted(spark, monkeypatch):
    """Not only the first id of each word: the attention is fitted on, and scores, every id of every text."""
    seen, fit = {}, lm.fit_model

    def noted(training, counts, begins):
        seen["ids"] = sorted(tuple(r["ids"]) for r in training.collect())
        seen["counts"] = counts
        return fit(training, counts, begins)

    monkeypatch.setattr(lm, "fit_model", noted)
    monkeypatch.setattr(lm, "WORDS_AT_ONCE", 50)
    texts = [(i, f"Unbelievably{i} reorganised abab  x{'y' * i}\n" * 9) for i in range(12)] + [(20, None), (21, "")]
    got = lm.lm_scores(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), TOKENIZER).collect()
    held, coder = {r["doc_id"] for r in got if r["held_out"]}, lm.subwords(TOKENIZER)
    expected = [(*[x for w in (t or "").lower().split() for x in coder.ids(w.encode())], coder.end) for i, t in texts if i not in held]
    assert len(got) == len(texts) and seen["ids"] == sorted(expected)
    assert sum(seen["counts"]) == sum(map(len, expected)) > sum(r["n_tokens"] for r in got if not r["held_out"])


def test_the_attention_reads_the_ids_inside_words(spark):
    """A change of an id inside a word changes the figures of its own word and of the next one."""
    model, shares = toy_model(), trained_shares(spark, {"a": 5, "ab": 4, "abba": 1})
    one, two = ([256, ord("a"), ord(x), 257, ord("b"), SIZE - 1] for x in "ab")
    first, second = (model.word_scores(np.array(x), np.array([6]), np.array([0, 0, 7]), shares) for x in (one, two))
    assert (first[:2] != second[:2]).all()


def test_words_scored_by_attention_and_counts_add_up_to_one_at_most(spark):
    counts = {"a": 5, "b": 3, "ab": 4, "abab": 1, "bba": 1, "aab": 2}
    shares, coder, model = trained_shares(spark, counts), lm.subwords((TOY, public.PATTERN)), toy_model()
    before, total = coder.ids(b"abba"), 0.0
    for n in range(1, 9):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            ids = coder.ids(word.encode())
            got = model.word_scores(np.array([*before, *ids, SIZE - 1]), np.array([len(before) + len(ids) + 1]), np.array([0, counts.get(word, 0), 7]), shares)
            # by hand: the first id among those that begin words, then the mixture
            p, new = model.places(np.array([*before, *ids, SIZE - 1]), np.array([len(before) + len(ids) + 1]))
            at, rest = len(before), shares.given_first(*lm._flat(coder, [word.encode()]), np.array([counts.get(word, 0)]))[0]
            spelled = np.prod(p[at + 1 : at + len(ids)]) * new[at + len(ids)]
            plain = p[at] / new[at] * ((1 - lm.MIX) * rest + lm.MIX * spelled)
            assert 10 ** got[1] == pytest.approx(plain)
            total += plain
    end = model.word_scores(np.array([*before, SIZE - 1]), np.array([len(before) + 1]), np.array([0, 7]), shares)
    assert 0 < total + 10 ** end[1] <= 1


def test_words_of_groups_are_packed(spark, monkeypatch):
    """A group's words move as a few rows of many words, and come back with their places, ids and counts in all training texts."""
    monkeypatch.setattr(lm, "GROUP_BYTES", 2_000)
    draw = np.random.default_rng(4)
    texts = [(i, i % 4 == 1, 0, " ".join(f"w{x} é{x % 7}" for x in draw.integers(0, 200, 60))) for i in range(60)] + [(60, False, 0, None)]
    docs = spark.createDataFrame(texts, "doc_id long, held_out boolean, part int, text string").repartition(6)
    coded = lm.coded_texts(docs, 5).cache()
    rows, packs = coded.where("at IS NOT NULL").collect(), coded.where("words IS NOT NULL")
    groups, coder = {r["p"] for r in packs.collect()}, lm.subwords(TOKENIZER)
    assert len(groups) > 4 and packs.count() <= 5 * len(groups) and len(rows) == len(texts)
    count = {}
    for _, out, _, t in texts:
        for w in (t or "").encode().split():
            count[w] = count.get(w, 0) + (not out)
    once, of_group = [], {p: {} for p in groups}
    for r in lm.counted_words(packs, TOKENIZER).collect():
        n, ids = lm._numbers(r["n"]), np.frombuffer(r["ids"], dtype=lm._type(coder.end)).tolist()
        own = [tuple(ids[e - k : e]) for k, e in zip(n, np.cumsum(n))]
        figures = list(zip(own, lm._numbers(r["c"], "<i8").tolist()))
        if r["p"] is None:
            once += figures
        else:
            of_group[r["p"]].update(zip(lm._numbers(r["place"]).tolist(), figures))
    assert sorted(once) == sorted((tuple(coder.ids(w)), c) for w, c in count.items())
    by_id = {i: (t or "").encode().split() for i, _, _, t in texts}
    for r in rows:
        got = [of_group[r["p"]][x] for x in lm._numbers(r["at"]).tolist()] if by_id[r["doc_id"]] else []
        assert got == [(tuple(coder.ids(w)), count[w]) for w in by_id[r["doc_id"]]]


def test_rows_that_are_shuffled_do_not_follow_the_words(spark, monkeypatch):
    """Neither the words of a group nor the different words of all have a row each."""
    many, write = {}, lm.written

    def noted(df, label, *args):
        out = write(df, label, *args)
        many[label] = out.count()
        return out

    monkeypatch.setattr(lm, "written", noted)
    texts = [(i, " ".join(f"word{i * 100 + j}" for j in range(200))) for i in range(40)]
    assert lm.lm_scores(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), TOKENIZER).count() == 40
    assert many["coded"] < 100 and many["words"] < 100
