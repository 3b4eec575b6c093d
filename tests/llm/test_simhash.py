from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from millrace.llm import simhash
from millrace.llm.components import components


def brute(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids):
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    label = np.array([2**63 - 1 if i is None else i for i in ids])
    while True:
        new = np.where(near, label[None], 2**63 - 1).min(1)
        if (new == label).all():
            return label
        label = new


def test_near_duplicates(docs, texts):
    rows = simhash.near_duplicates(docs).collect()
    fps = np.array([brute(t) for _, t in texts], np.uint64)
    want = Counter(zip([i for i, _ in texts], fps.view(np.int64).tolist(), classes(fps, [i for i, _ in texts]).tolist(), strict=True))
    assert Counter((r.doc_id, r.fp, 2**63 - 1 if r.component_id is None else r.component_id) for r in rows) == want


@pytest.mark.parametrize("block", [8, 2048])
def test_links_of_a_dense_group(spark, block):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base[rng.integers(0, 2, 400)] ^ flips[:, 0] ^ flips[:, 1], base[rng.integers(0, 30, 400)] ^ np.bitwise_xor.reduce(flips, axis=1)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(df, block)
    assert edges.count() < 40 * len(fps)
    root = {r.node: r.root for r in components(edges).collect()}
    signed = fps.view(np.int64).tolist()
    assert [root.get(x, x) for x in signed] == classes(fps, signed).tolist()


def test_long_chain(spark):
    rows = [(k, k + 1) for k in range(300)] + [(900, 1000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert len(found) == 303 and found[300] == 0 and found[1000] == 900
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
