"""Each query against a plain version of what it returns."""

import hashlib
import zlib
from collections import Counter, defaultdict
from math import log10

import public_tokenizers as public
import pytest
import tiktoken
import xxhash

from tidemark.llm.bpe import read_ranks
from tidemark.llm.queries import QUERIES

RANKS = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def words(text, lower=False) -> list[bytes]:
    b = (text or "").encode()
    return (b.translate(LOWER) if lower else b).split()


def held(doc_id: int, folds: int, which: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == which


@pytest.fixture(scope="module")
def result(spark, sf_dir, docs):
    kept = {}

    def get(name):
        if name not in kept:
            rows = QUERIES[name](spark, sf_dir).collect()
            kept[name] = {r["doc_id"]: r for r in rows}
            assert len(rows) == len(docs) == len(kept[name])
        return kept[name]

    return get


def test_op1(result, docs):
    coder = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    got = result("op1_bpe_roundtrip")
    for d in docs:
        ids, r = coder.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(",".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == sha((d["text"] or "").encode())


def test_op2(result, docs):
    got, by_text = result("op2_telephony_audio"), {}
    for d in docs:
        b, r = (d["text"] or "").encode(), got[d["doc_id"]]
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(b), len(payload))
        assert r["payload_sha256"] == sha(payload)
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] > len(payload)
        assert by_text.setdefault(d["text"] or "", r[5:]) == r[5:]


def test_op3(result, docs):
    got, by_text = result("op3_order_minhash"), {}
    for i, d in enumerate(docs):
        own, after = d["text"] or "", docs[(i + 1) % len(docs)]
        half = len(own) // 2
        edited = own[: len(own) - half] + (after["text"] or "")[:half]
        r = got[d["doc_id"]]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == sha(edited.encode())
        assert by_text.setdefault(own, r["fingerprint"]) == r["fingerprint"]
        assert by_text.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert r["near_edited"] == 1 or own != edited
        if own == (after["text"] or ""):
            assert r["near_next"] == 1
    long = [r for r in got.values() if r["n_chars"] > 500]
    assert sum(r["near_edited"] for r in long) > sum(r["near_next"] for r in long)


def test_op4(result, docs):
    def fingerprint(text):
        ws = words(text, lower=True)
        shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d["doc_id"]: fingerprint(d["text"]) for d in docs}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = result("op4_simhash_components")
    for d in ids:
        assert got[d]["fingerprint"] == f"{prints[d]:016x}"
        assert got[d]["component_id"] == find(d)


def test_op5(result, docs):
    longest, known = max(map(len, RANKS)), {}

    def pieces(word):
        if word not in known:
            n, at = 0, 0
            while at < len(word):
                at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in RANKS)
                n += 1
            known[word] = n
        return known[word]

    got = result("op5_longest_match_counts")
    for d in docs:
        ws = words(d["text"])
        assert (got[d["doc_id"]]["n_words"], got[d["doc_id"]]["n_tokens"]) == (len(ws), sum(pieces(b" " + w) for w in ws))


def test_op6(spark, sf_dir, result):
    got = result("op6_ordinal_quality")
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["doc_id"] in got]
    right = sum(got[r["doc_id"]]["keep"] == (r["quality"] == 1 and r["toxic"] == 0) for r in labels)
    assert right >= 0.9 * len(labels)
    for r in got.values():
        assert 0 <= r["tail_prob"] <= r["sound_prob"] <= 1
        assert r["expected_grade"] == pytest.approx(r["tail_prob"] + r["sound_prob"])


def test_op7(result, docs):
    got, size = result("op7_mix_sources"), {d["doc_id"]: len(words(d["text"])) for d in docs}
    total = Counter()
    for d in docs:
        total[d["source"]] += size[d["doc_id"]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(total.values()))
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in over} if over else {s: unit * weight[s] for s in free}
        rest -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = Counter()
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[d["doc_id"]], total[d["source"]])
        assert r["target"] == pytest.approx(target[d["source"]])
        assert r["taken"] <= 3 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        taken[d["source"]] += r["taken"]
    for s in names:
        # whole passes, and the subset of documents that comes nearest to the rest
        sums = 1
        for d in docs:
            if d["source"] == s:
                sums |= sums << size[d["doc_id"]]
        passes = min(3, int(target[s] // total[s])) if total[s] else 0
        left = target[s] - passes * total[s]
        nearest = min(abs(left - w) for w in range(total[s] + 1) if sums >> w & 1) if passes < 3 else 0
        assert abs(taken[s] - target[s]) <= nearest + 1


def test_op8(result, docs):
    got = result("op8_hyperdimensional_language")
    tested = [d for d in docs if held(d["doc_id"], 4, 2) and d["lang"] and d["doc_id"] < 10_000_000]
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in tested) >= 0.9 * len(tested)
    known = {d["lang"] for d in docs if d["lang"]} | {"und"}
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == held(d["doc_id"], 4, 2)
        assert r["lang_pred"] in known and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in d["text"] or ""))


def test_op9(result, docs):
    got, count = result("op9_attention_lm"), Counter()
    tokens = {d["doc_id"]: [*words(d["text"], lower=True), None] for d in docs}
    for d, ts in tokens.items():
        if not held(d, 5, 1):
            count.update(ts)
    n, v = sum(count.values()), len(count)
    for d, ts in tokens.items():
        r = got[d]
        assert r["held_out"] == held(d, 5, 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(count[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
        assert r["score"] < 0


def test_op9_beats_the_base_when_held_out(result):
    out = [r for r in result("op9_attention_lm").values() if r["held_out"] and r["doc_id"] < 10_000_000]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op9_beats_the_base_on_known_tokens_when_held_out(result, docs):
    """Tokens of training apart from others, which the base doesn't spell; repeated tokens count each time."""
    got, count = result("op9_attention_lm"), Counter()
    tokens = {d["doc_id"]: [*words(d["text"], lower=True), None] for d in docs}
    for d, ts in tokens.items():
        if not held(d, 5, 1):
            count.update(ts)
    n, v = sum(count.values()), len(count)
    for d, ts in tokens.items():
        assert got[d]["known_base"] == pytest.approx(sum(log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts if count[t]))
        assert got[d]["score"] - 1e-6 <= got[d]["known_score"] < 0
    out = [r for r in got.values() if r["held_out"] and r["doc_id"] < 10_000_000]
    assert sum(r["known_score"] for r in out) > sum(r["known_base"] for r in out)


def plain_dedup(docs, window=50):
    """(words, kept words) by doc_id."""
    first, out = {}, {}
    by_id = sorted((d for d in docs if d["doc_id"] is not None), key=lambda d: d["doc_id"])
    for d in by_id:
        ws = words(d["text"])
        for i in range(len(ws) - window + 1):
            first.setdefault(hashlib.md5(b" ".join(ws[i : i + window])).digest(), d["doc_id"])
    for d in by_id:
        ws = words(d["text"])
        gone = [0] * (len(ws) + 1)
        for i in range(len(ws) - window + 1):
            if first[hashlib.md5(b" ".join(ws[i : i + window])).digest()] < d["doc_id"]:
                gone[i] += 1
                gone[i + window] -= 1
        depth, kept = 0, []
        for w, g in zip(ws, gone):
            depth += g
            if not depth:
                kept.append(w)
        out[d["doc_id"]] = ws, kept
    return out


def test_op10(result, docs):
    got = result("op10_debruijn_dedup")
    for d, (ws, kept) in plain_dedup(docs).items():
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(ws), len(ws) - len(kept), sha(b" ".join(kept)))


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "tokens"]
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held_rows = now.columns, {}
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        rows = now.collect()
        held_rows[name] = rows
        now = spark.createDataFrame(rows, now.schema)
        if name != "tokens":
            assert now.columns == columns
    ids = lambda name: {r["doc_id"] for r in held_rows[name]}
    assert ids("near_dedup") <= ids("quality") <= {d["doc_id"] for d in docs}
    kept = plain_dedup([r.asDict() for r in held_rows["near_dedup"]])
    for r in held_rows["substring_dedup"]:
        assert words(r["text"]) == kept[r["doc_id"]][1]
    copies = Counter(r["doc_id"] for r in held_rows["mixing"])
    assert max(copies.values()) <= 3
    coder = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in held_rows["mixing"]}
    assert Counter(r["doc_id"] for r in held_rows["tokens"]) == copies
    for r in held_rows["tokens"]:
        assert r["ids"] == coder.encode_ordinary(text[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"])
    by_group = defaultdict(set)
    for r in QUERIES["op4_simhash_components"](spark, sf_dir).collect():
        by_group[r["component_id"]].add(r["doc_id"])
    assert all(len(ids("near_dedup") & g) <= 1 or not g <= ids("quality") for g in by_group.values())
