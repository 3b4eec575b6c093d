import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import lexical_packing as p
from millrace.llm.word_tokens import WordTokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_the_tokenizer(texts):
    own, whole = WordTokens(PATH), Tokenizer.from_file(PATH)
    odd = ["Σας ΟΔΟΣ", "I'm <|endoftext|>x", "e\u0301 te\u0301st \u0308", "İstanbul", "x\xa0y\u3000z", "\r\n\t a'LL", "a\x1cb"]
    for t in [t for _, t in texts if t] + odd:
        assert own(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), t[:50]


def test_each_code_point_is_the_tokenizer():
    own, whole = WordTokens(PATH), Tokenizer.from_file(PATH)
    for k in range(0x300):
        for t in (chr(k), f"a{chr(k)}b", f"{chr(k)}{chr(k)}_1"):
            assert own(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), (k, t)


@pytest.mark.parametrize("shard_tokens", [1 << 20, 3000])
def test_round_trip(docs, texts, shard_tokens):
    own = WordTokens(PATH)
    rows = p.pack(docs, PATH, window=256, shard_tokens=shard_tokens).collect()
    want = Counter()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in texts:
        ids = np.frombuffer(own(t or "") + (2).to_bytes(2, "little"), "<u2").astype("<u4").tobytes()
        want[i, len(ids) // 4] += len(ids) // 4
        for r in pieces[i, len(ids) // 4]:
            if Counter((a, b if b is None else len(own(b))) for a, b in texts)[i, len(own(t or ""))] == 1:
                assert r.ids_crc32 == crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    got = Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert s[0].offset == 0 and sum(r.length for r in s) <= 256
        assert all(a.offset + a.length == b.offset for a, b in zip(s, s[1:], strict=False))
    total = sum(r.length for r in rows)
    # a shard's last window can be short
    assert len(sequences) * 256 - total <= 256 * (len({r.sequence_id >> 32 for r in rows}) + total // shard_tokens)


def test_neighbours_are_ranked():
    rng = np.random.default_rng(0)
    a, b = rng.integers(10, 60, 90), rng.integers(100, 160, 90)
    ids = [np.append(rng.permutation(a if k % 2 else b)[:60], 2).astype("<u4") for k in range(12)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=200)
    idf = np.maximum(0, np.log((len(ids) - df + 0.5) / (df + 0.5) + 0.5))
    packed = p.pack_shard(ids, idf, 61.0, 183)
    whole = [{d % 2 for d, _, n, s, _ in packed if s == q} for q in {x[3] for x in packed}]
    assert sum(len(x) == 1 for x in whole) >= 3


def test_empty(empty):
    assert p.pack(empty, PATH).count() == 0


def brute_scores(ids, df, n, mean, k):
    """Textbook BM25 of all documents for the distinct terms of document ``k``."""
    out = []
    for x in ids:
        tf, s = Counter(x.tolist()), 0.0
        for t in sorted(set(ids[k].tolist())):
            idf = max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5)))
            s += idf * tf[t] * (p.K1 + 1) / (tf[t] + p.K1 * (1 - p.B + p.B * len(x) / mean)) if tf[t] else 0.0
        out.append(s)
    return out


def test_scores_are_bm25():
    rng = np.random.default_rng(1)
    ids = [rng.zipf(1.3, rng.integers(5, 200)).clip(0, 500).astype("<u2") for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=501)
    mean = sum(map(len, ids)) / len(ids)
    idf = np.maximum(0, np.log((len(ids) - df + 0.5) / (df + 0.5)))
    index = p.Index(ids, idf, mean)
    for k in range(60):
        assert np.allclose(index.scores(k), brute_scores(ids, df, 60, mean, k))
    first, second = p.heaviest(ids, idf, mean)
    for k, x in enumerate(ids):
        tf = Counter(x.tolist())
        w = sorted((-idf[t] * f * (p.K1 + 1) / (f + p.K1 * (1 - p.B + p.B * len(x) / mean)), t) for t, f in tf.items() if idf[t] > 0)
        assert [first[k], second[k]] == ([t for _, t in w] + [-1, -1])[:2]


def test_best_ranked_that_fit_come_first():
    """Windows against a plain version of the greedy filling, with many small documents."""
    rng = np.random.default_rng(2)
    ids = [rng.integers(10, 60 + 40 * (k % 3), rng.integers(1, 30)).astype("<u2") for k in range(200)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=200)
    mean = sum(map(len, ids)) / len(ids)
    idf = np.maximum(0, np.log((len(ids) - df + 0.5) / (df + 0.5)))
    index, left, want = p.Index(ids, idf, mean), [len(x) for x in ids], []
    for seed in sorted(range(200), key=lambda d: -len(ids[d])):
        if not left[seed]:
            continue
        room, got = 1000, []
        score = index.scores(seed)
        order = [seed] + [d for d in sorted(range(200), key=lambda d: -score[d]) if d != seed]
        for whole in (True, False):
            for d in order:
                take = min(left[d], room)
                if take and (take == left[d] or not whole):
                    got.append((d, take))
                    left[d], room = left[d] - take, room - take
        want.append(got)
    packed = p.pack_shard(ids, idf, mean, 1000)
    assert [[(d, n) for d, _, n, s, _ in packed if s == q] for q in range(len(want))] == want


def test_copies_of_one_text_are_dealt_out(spark):
    docs = spark.createDataFrame([(k % 7 or None, "the same text " * 20) for k in range(600)], "doc_id long, text string")
    rows = p.pack(docs, PATH, window=256).collect()
    assert len({r.sequence_id >> 32 for r in rows}) == 4 and sum(r.length for r in rows) == 600 * 61


def test_neighbours_share_a_shard(spark):
    """Of documents on many subjects, most of the best-ranked neighbours over the whole corpus are in the same shard."""
    rng = np.random.default_rng(4)
    subjects = [["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(30)] for _ in range(60)]
    common = ["".join(rng.choice(list("qrstuvwxyz"), 3)) for _ in range(200)]
    texts = [" ".join([*rng.choice(subjects[k % 60], 20), *rng.choice(common, 60)]) for k in range(900)]
    rows = p.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, window=512, shard_tokens=6000).collect()
    together = {}
    for r in rows:
        together.setdefault(r.doc_id, set()).add(r.sequence_id)
    same = [len({d % 60 for d, q in together.items() if s in q}) for s in {r.sequence_id for r in rows}]
    assert np.mean(same) < 3  # windows hold about six documents: of 60 subjects these would be nearly all different


def test_a_shard_of_small_documents_is_packed_in_one_pass_a_window():
    """Windows of 4,096 one-token documents; the neighbours of a seed come first, then the others in their order."""
    ids = [np.array([2], np.uint16)] * (1 << 17)
    out = p.pack_shard(ids, np.zeros(10), 1.0)
    assert [x[0] for x in out] == list(range(1 << 17)) and all(x[2] == 1 and x[3] == k // 4096 and x[4] == k % 4096 for k, x in enumerate(out))
    ids[100_000] = ids[7] = np.array([5, 2], np.uint16)
    out = p.pack_shard(ids, np.eye(10)[5], 1.0)
    assert [x[0] for x in out[:5]] == [7, 100_000, 0, 1, 2]
