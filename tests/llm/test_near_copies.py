import random

import numpy as np

import corpus_pipeline as c
from millrace.llm import near_copies as n

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def classes(sets):
    """Of all pairs: a class number for each set."""
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if near(sets[i], sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited_texts(rng):
    pool = [f"w{k}" for k in range(500)]
    texts = [[rng.choice(pool) for _ in range(rng.choice([6, 20, 80, 300, 900]))] for _ in range(40)]
    for k in range(160):
        w = list(texts[rng.randrange(40 + k)])
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            w[rng.randrange(len(w))] = rng.choice(pool)
        texts.append(w)
    return [" ".join(w) for w in texts]


def test_stage_keeps_one_of_each_component(spark):
    """Against all pairs: random edits that leave similarities on both sides of 0.8, null and repeated ids, repeated rows."""
    rng = random.Random(7)
    texts = edited_texts(rng)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(900, "", "en", "s", 1), (901, None, "en", "s", 1), (902, "a", "en", "s", 1), (903, "A", "en", "s", 1), (None, "a", "en", "s", 1), (None, "only without id", "en", "s", 1), (None, "only without id", "de", "s", 1)]
    rows += [(5, "X " + texts[3], "en", "s", 1), (5, "quite another text under the same id", "en", "s", 1), rows[8], (8, texts[8], "de", None, 2)]
    label = classes([shingles(r[1]) for r in rows])
    want = {}
    for r, x in zip(rows, label, strict=True):
        want.setdefault(x, []).append(r)
    assert 40 < len(want) < 200
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [tuple(r) for r in c.near_dedup(spark, docs, "").collect()]
    assert len(kept) == len(want)
    of = {r: x for r, x in zip(rows, label, strict=True)}
    assert {of[r] for r in kept} == set(want)
    for r in kept:
        ids = [i for i, *_ in want[of[r]] if i is not None]
        assert r[0] == (min(ids) if ids else None)
    found = {}
    for r in n.near_copies(docs).collect():
        found.setdefault(r.component_id, []).append(r.doc_id)
    assert sum(map(len, found.values())) == len(rows)


def test_blocks_do_not_change_links(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame(list(enumerate(edited_texts(rng))), "doc_id long, text string")
    one, many = ({(r.doc_id, r.component_id) for r in n.near_copies(docs, block=b).collect()} for b in (4 << 20, 1000))
    assert one == many


def test_pairs_are_tried_in_their_first_band():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(150, 200), replace=False), rng.integers(0, 2**63, 20, dtype=np.uint64)))) for _ in range(30)]
    tags = np.stack([n.bands(x) for x in sets]).astype("<u4")
    fps = np.array([n.majority(x) for x in sets], np.uint64)
    top = list(range(len(sets)))
    for band in range(n.BANDS):
        for key in np.unique(tags[:, band]):
            own = np.flatnonzero(tags[:, band] == key)
            for x, y in n.linked([sets[k] for k in own], fps[own], tags[own], band):
                x, y = int(own[x]), int(own[y])
                assert near(frozenset(sets[x].tolist()), frozenset(sets[y].tolist()))
                top = [top[x] if t == top[y] else t for t in top]
    want = classes([frozenset(x.tolist()) for x in sets])
    assert [top.index(t) for t in top] == [want.index(t) for t in want]


def test_operator_4_links_without_common_keys(spark):
    """Links within 3 bits come from operator 4's join: found where no two texts share a key of minimum hashes; what it links below 0.8 is dropped."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(900)]
    texts = [" ".join(rng.sample(words, 800)) for _ in range(4)]
    texts += [" ".join([*t.split()[:-1], "another"]) for t in texts for _ in range(1)] + ["short text", "one more short text here"]
    docs = n._rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    rows = n._keyed(docs)
    alone = rows.withColumn("keys", n.F.transform("keys", lambda x: n.F.xxhash64(x, "node")))
    node = {r.doc_id: r.node for r in rows.collect()}
    fps = [n.majority(n.shingle_set(t.encode())) for t in texts]
    want = {tuple(sorted((node[i], node[i + 4]))) for i in range(4) if (fps[i] ^ fps[i + 4]).bit_count() <= 3}
    assert want
    for block in (4 << 20, 1000):
        assert {(r.a, r.b) for r in n._links(docs, alone, block).collect()} == want


def test_empty(spark):
    assert c.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
