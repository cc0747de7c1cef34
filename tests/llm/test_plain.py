"""Operators beside plain versions of themselves."""

import hashlib
import io
import math
import random
import wave
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
import tiktoken

from tidemark.llm import audio, bpe, hyperdim, ordinal, simhash, substring
from tidemark.llm.common import join_heavy, perhaps_among
from tidemark.llm.omh import OrderMinHash, likeness, mix

RANKS = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))


# ---- byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(RANKS, public.PATTERN)


@pytest.mark.parametrize(
    "letters, length, words",
    [([chr(c) for c in range(0x4E00, 0x9FFF)], 12, 15_000), ([chr(c) for c in range(0x430, 0x450)], 25, 3_000), (list("etaoinshrdlu"), 40, 15_000), ([chr(c) for c in range(0x4E00, 0x9FFF)], 700, 2), (list("ACGT"), 20_000, 1), (["a"], 9_001, 1)],
)
def test_bpe_contracts_words_of_any_length(coder, letters, length, words):
    draw = random.Random(length)
    text = " ".join("".join(draw.choice(letters) for _ in range(length)) for _ in range(words))
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert coder.encode([text])[0].tolist() == plain.encode_ordinary(text)


def test_long_words_are_contracted_as_by_the_leftmost_pair_of_least_rank(coder):
    def plain(word: bytes) -> list[int]:
        parts = [bytes([b]) for b in word]
        while True:
            ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
            if not ranked:
                return [RANKS[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw = random.Random(5)
    for letters in ("ab", "the ", "0", "xyzzy", "=-"):
        word = "".join(draw.choice(letters) for _ in range(300)).replace(" ", "").encode()
        assert np.frombuffer(coder.contract_long(word), dtype=np.int32).tolist() == plain(word)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "etaoin", "0123456789", "\u0430\u0431\u0432\u0433\u0434"])
def test_long_words_in_pieces_are_those_of_a_library(coder, letters):
    plain = tiktoken.Encoding("plain", pat_str=r"[\s\S]+", mergeable_ranks=RANKS, special_tokens={})
    draw = random.Random(letters)
    for n in (1_001, 2_500, 30_000):
        word = "".join(draw.choice(letters) for _ in range(n))
        assert np.frombuffer(coder.contract_long(word.encode()), dtype=np.int32).tolist() == plain.encode_ordinary(word)
    word = letters * (3_000 // len(letters))
    assert np.frombuffer(coder.contract_long(word.encode()), dtype=np.int32).tolist() == plain.encode_ordinary(word)


def test_a_text_of_very_many_ids_is_decoded_in_parts():
    decoder = bpe.Decoder(RANKS)
    ids = np.random.default_rng(1).integers(0, 50_000, 1_000_000).tolist()
    by_id = {i: t for t, i in RANKS.items()}
    found = decoder.decode(pa.array([[], ids, None, ids[:3]], pa.list_(pa.int32())))
    assert found == [b"", b"".join(map(by_id.__getitem__, ids)), b"", b"".join(map(by_id.__getitem__, ids[:3]))]


def test_bpe_with_another_pattern_cuts_no_segments():
    other = bpe.Encoder(RANKS, r"\S+|\s+")
    assert not other.even and other.segments("one two") == ["one", " ", "two"]


# ---- telephony audio


def plain_mulaw(code: int) -> int:
    code = ~code & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return -size if code & 128 else size


def plain_alaw(code: int) -> int:
    code ^= 0x55
    size, segment = ((code & 15) << 4) + 8, code >> 4 & 7
    size = size if not segment else (size + 256) << (segment - 1)
    return size if code & 128 else -size


def plain_adpcm(block: bytes) -> list[int]:
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.MOVES[code & 7])))
            out.append(value)
    return out


def test_audio_is_expanded_as_plainly(spark):
    draw = random.Random(3)
    payloads = [bytes(draw.randrange(256) for _ in range(n)) for n in (0, 1, 64, 65, 150, 200, 1000)] + [None]
    stored = audio.store_audio(spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "doc_id long, payload binary"))
    rows = {r["doc_id"]: r for r in audio.read_audio(stored, pcm="pcm").collect()}
    for i, p in enumerate(payloads):
        data = audio.pad(p or b"")
        codec, rate, kept = audio.parse_wav(rows[i]["media"])
        assert kept == data == rows[i]["payload"] and rate == 8000
        plain = [x for at in range(0, len(data), 64) for x in plain_adpcm(data[at : at + 64])] if codec == "ima_adpcm" else [(plain_mulaw if codec == "mulaw" else plain_alaw)(b) for b in data]
        assert audio.expand(codec, np.frombuffer(data, dtype=np.uint8)).tolist() == plain
        with wave.open(io.BytesIO(rows[i]["pcm"])) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, 2, 16000, 2 * len(plain))
            other = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")
        assert other.tolist() == plain_resampled(plain)
    assert {audio.parse_wav(r["media"])[0] for r in rows.values()} == set(audio.CODECS)


def plain_resampled(pcm: list[int], half: int = 4) -> list[int]:
    """Twice the rate: each sample, and what a windowed sinc of integer taps makes of its neighbours half way to the next."""
    out = []
    for part in (0.0, 0.5):
        taps = [np.sinc(j - part) * math.cos(math.pi * (j - part) / (2 * half + 1)) ** 2 for j in range(1 - half, half + 1)]
        taps = [int(np.rint(t / sum(taps) * 16384)) for t in taps]
        at = lambda i: pcm[i] if 0 <= i < len(pcm) else 0
        out.append([max(-32768, min(32767, (8192 + sum(t * at(i + j) for j, t in zip(range(1 - half, half + 1), taps))) >> 14)) for i in range(len(pcm))])
    return [x for pair in zip(*out) for x in pair]


def test_media_over_a_batch_are_read_whole():
    big = audio.wav("mulaw", bytes(range(256)) * 36_000, 8000, 9_216_000)
    found = [x for some in audio._chunks([big, None, big]) for x in audio._decoded(some)]
    assert len(found) == 3 and found[1] is None and found[0][3].tolist()[:256] == [plain_mulaw(b) for b in range(256)]


# ---- Order MinHash


def plain_signature(text: str, scheme: OrderMinHash) -> list[int]:
    """By Python's lists: occurrence-numbered k-mers, the l least of each order, hashed in text order."""
    if not text:
        return [0] * scheme.m
    whole = (1 << 64) - 1
    odd, k = 0x9E3779B97F4A7C15, min(scheme.k, len(text))
    one = lambda x: int(mix(np.array([x & whole], dtype=np.uint64))[0])
    seen: Counter = Counter()
    hashes = []
    for i in range(len(text) - k + 1):
        gram = text[i : i + k]
        h = one(sum((ord(c) + 1) * odd ** (k - 1 - j) for j, c in enumerate(gram)))
        hashes.append(one(h + seen[gram] * odd) if seen[gram] else h)
        seen[gram] += 1
    draw = np.random.default_rng(scheme.seed)
    factor = [int(x) * 2 + 1 & whole for x in draw.integers(0, 1 << 63, scheme.m, dtype=np.uint64)]
    flip = [int(x) for x in draw.integers(0, 1 << 63, scheme.m, dtype=np.uint64)]
    out = []
    for f, x in zip(factor, flip):
        least = sorted(range(len(hashes)), key=lambda i: ((hashes[i] ^ x) * f & whole, i))[: scheme.l]
        total = scheme.seed
        for i in sorted(least):
            total = one(total * odd + hashes[i])
        out.append(total >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abababababababab" * 4, "The quick brown fox jumps over the lazy dog. " * 3, "éß中文 \U0001f600 mixed"])
def test_order_minhash_is_the_plain_one(text):
    scheme = OrderMinHash(m=8)
    assert scheme.signature(text).tolist() == plain_signature(text, scheme)


def test_order_minhash_follows_the_order_of_a_text():
    draw = random.Random(2)
    scheme, parts = OrderMinHash(), ["".join(draw.choice("abcdefgh ") for _ in range(40)) for _ in range(40)]
    own = scheme.signature("".join(parts))
    assert likeness(own, scheme.signature("".join(reversed(parts)))) < likeness(own, scheme.signature("".join(parts[:20] + parts[21:])))


# ---- SimHash by ball hashing


def test_simhash_links_just_those_within_three_bits(spark):
    draw = random.Random(7)
    prints = [draw.getrandbits(64) for _ in range(250)] + [0, (1 << 64) - 1]
    for n in (1, 2, 3, 4, 5):
        for base in prints[:60]:
            bits = draw.sample(range(64), n)
            prints.append(base ^ sum(1 << b for b in bits))
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")), "fp", "rep").collect()}
    assert {p: got.get(p, p) for p in prints} == {p: find(p) for p in prints}


# ---- ordinal quality


def test_cumulative_link_gradients_are_those_of_small_changes():
    draw = np.random.default_rng(2)
    score, theta, grades = draw.standard_normal(9), np.array([-0.7, 0.4]), np.arange(9) % 3

    def tails(s, t):
        return 1 / (1 + np.exp(t[None, :] - s[:, None]))

    def loss(s, t):
        whole = np.concatenate([np.ones((9, 1)), tails(s, t), np.zeros((9, 1))], axis=1)
        return -np.log(whole[np.arange(9), grades] - whole[np.arange(9), grades + 1])

    by_score, by_cut = ordinal.cumulative_link_gradients(tails(score, theta), grades)
    assert by_score == pytest.approx((loss(score + 1e-6, theta) - loss(score - 1e-6, theta)) / 2e-6, abs=1e-5)
    for j in range(2):
        step = np.eye(2)[j] * 1e-6
        assert by_cut[:, j] == pytest.approx((loss(score, theta + step) - loss(score, theta - step)) / 2e-6, abs=1e-5)


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    graded = ordinal.label_grades(labels).where("grade IS NOT NULL")
    model = ordinal.train(docs, graded.where("doc_id % 4 <> 1"))
    assert (np.diff(model.thresholds) > 0).all()
    rows = ordinal.rate(docs.join(graded.where("doc_id % 4 = 1"), "doc_id"), model).collect()
    for grade, least in ((0, 0.85), (2, 0.9)):
        own = [(r["tail_prob"] >= 0.5) == (grade == 2) for r in rows if r["grade"] == grade]
        assert len(own) > 10 and sum(own) >= least * len(own)


def test_a_document_with_several_texts_is_fitted_once(spark):
    docs = spark.createDataFrame([(i % 4, f"word{i % 4} text {i}") for i in range(40)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(4)] + [(None, 1), (9, None)], "doc_id long, grade int")
    assert ordinal.train(docs, ratings, sample=3) is not None and ordinal.train(docs, ratings.where("grade > 5")) is None


# ---- hyperdimensional languages


def test_language_vectors_are_the_plain_ones(spark):
    space = hyperdim.Space(dimensions=64)
    bundler = hyperdim.Bundler(space)

    def plain(text: str) -> np.ndarray:
        low, letters = text.lower(), []
        for c in low:
            if c.isalpha():
                letters.append(c)
            elif not letters or letters[-1] != " ":
                letters.append(" ")
        padded = ("" if letters and letters[0] == " " else " ") + "".join(letters) + ("" if letters and letters[-1] == " " else " ")
        total = np.zeros(space.dimensions)
        if any(c.isalpha() for c in low):
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                va, vb, vc = (bundler.letter(ord(x)).astype(float) for x in (a, b, c))
                total += va[bundler.order][bundler.order] * vb[bundler.order] * vc
        return total

    texts = ["Hello, world", "a", "", " 12 ", "Éréier en-queeau", "--x--"]
    for t in texts:
        grams = bundler.trigrams(t)
        assert np.array_equal(bundler.bundle(grams), plain(t)), t
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = hyperdim.learn(docs, space)
    for name in ("en", "fr"):
        v = sum(plain(t) for _, t, n in rows if n == name)
        assert learned[name] == pytest.approx(v / np.linalg.norm(v))
    same = {"zz": learned["en"], "aa": learned["en"]}
    got = {r["doc_id"]: r for r in hyperdim.identify(docs, same, space).collect()}
    assert got[0]["lang_pred"] == "aa" and got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[2]["score"] == 0.0


# ---- substring dedup


def test_a_passage_in_a_thousand_documents(spark):
    draw = random.Random(1)
    passage = " ".join(f"p{draw.randrange(10_000)}" for _ in range(80))
    fresh = iter(range(10**6))
    own = lambda i, n: " ".join(f"w{next(fresh)}" for _ in range(n))
    rows = [(i, f"{own(i, 30)} {passage} {own(i, 30)}") for i in range(1000)]
    rows += [(2000 + i, own(i, 90)) for i in range(50)] + [(3000, rows[3][1]), (3001, rows[3][1] + " more"), (3002, "short copy"), (3003, "short copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in substring.kept_digests(docs).collect()}
    assert all(got[i]["n_removed"] == (80 if i else 0) for i in range(1000))
    assert all(got[2000 + i]["n_removed"] == 0 for i in range(50))
    assert (got[3000]["n_removed"], got[3001]["n_removed"], got[3003]["n_removed"]) == (140, 140, 0)
    assert got[3001]["kept_sha256"] == hashlib.sha256(b"more").hexdigest()
    cut = {r["doc_id"]: r["text"] for r in substring.without_repeats(docs).collect()}
    assert cut[3000] == "" and cut[3001] == "more" and cut[0] == rows[0][1] and cut[5] == " ".join(rows[5][1].split()[:30] + rows[5][1].split()[-30:])


def test_windows_that_repeat_in_parts(spark):
    """Overlapping repeats of several sources, repeats within a document, and words that only a shorter span shares."""
    draw = random.Random(4)
    pool = [f"v{draw.randrange(99)}" for _ in range(400)]
    rows = []
    for i in range(60):
        parts = []
        while len(parts) < 260:
            at = draw.randrange(300)
            parts += pool[at : at + draw.choice((8, 30, 49, 50, 51, 90))]
            if draw.random() < 0.3:
                parts.append(f"u{draw.randrange(10**6)}")
        rows.append((i if i % 7 else i // 7, " ".join(parts + parts[:60] * (i % 5 == 0))))
    from test_contracts import plain_dedup

    unique = {}
    for d, t in rows:
        unique.setdefault(d, t)
    docs = [{"doc_id": d, "text": t} for d, t in unique.items()]
    want = plain_dedup(docs, 50)
    got = {r["doc_id"]: r for r in substring.kept_digests(spark.createDataFrame(list(unique.items()), "doc_id long, text string").repartition(5)).collect()}
    for d, (ws, kept) in want.items():
        assert (got[d]["n_removed"], got[d]["kept_sha256"]) == (len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_stretches_longer_than_a_block(monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 1 << 60, 1000, dtype=np.uint64)
    whole = substring.stretches(hashes)
    monkeypatch.setattr(substring, "STRETCH", 128)
    first, last, anchor = substring.stretches(hashes)
    at = lambda f, l, a: np.repeat(a, l - f + 1)
    assert np.array_equal(at(first, last, anchor), at(*whole)) and first[0] == 0 and last[-1] == 950


# ---- helpers


def test_join_heavy_and_the_map_of_keys(spark):
    left = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(3000)], "k long, i long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").where("k % 2 = 0")
    got = join_heavy(left, right, ["k"], ["i"])
    assert sorted(r["i"] for r in got.collect()) == [i for i in range(3000) if (0 if i % 3 == 0 else i) % 2 == 0]
    among = {r["k"] for r in perhaps_among(left, right.where("k < 500"), ["k"]).where("_among").collect()}
    assert {k for k in range(0, 500, 2) if k % 3} | {0} <= among and len(among) < 300


def test_bpe_words_of_like_lengths_share_a_query(monkeypatch):
    """A query takes as many steps as its longest word, so long words must not be spread over all queries."""
    coder, sizes = bpe.Encoder(RANKS, public.PATTERN), []
    contract = coder.contract
    monkeypatch.setattr(coder, "contract", lambda some: sizes.append([len(x) for x in some]) or contract(some))
    monkeypatch.setattr(bpe, "WORK_A_QUERY", 20_000)
    draw = np.random.default_rng(4)
    words = ["".join(draw.choice(list("bcdé"), n)) for n in draw.integers(5, 90, 300)]
    text = " ".join(words)
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert coder.encode([text])[0].tolist() == plain.encode_ordinary(text)
    assert len(sizes) > 20 and all(max(a) <= min(b) for a, b in zip(sizes, sizes[1:]))
    assert all(sum(x * x for x in some) <= 20_000 for some in sizes)
