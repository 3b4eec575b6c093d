import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import serving


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("metric", serving.METRICS)
def test_top_k_is_argsort(spark, metric):
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(20, 5)), rng.normal(size=(90, 5))
    got = serving.top_k(table(spark, q), table(spark, x), 7, metric, rows=16).orderBy("q", "rank").collect()
    s = q @ x.T
    if metric == "cosine":
        s = s / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])
    if metric == "l2":
        s = -np.linalg.norm(q[:, None] - x[None], axis=2)
    want = np.argsort(-s, axis=1)[:, :7]
    assert [r.id for r in got] == want.ravel().tolist()


def test_pool_self_seen_bias(spark):
    x = table(spark, np.eye(4) + 0.1)
    similar = serving.most_similar(x, x.where("id = 0"), 10, pool=x.where("id < 3"))
    assert sorted(r.id for r in similar.collect()) == [1, 2]
    seen = spark.createDataFrame([(0, 0)], "q long, id long")
    assert 0 not in [r.id for r in serving.top_k(x.where("id = 0"), x, 3, seen=seen).collect()]
    best = serving.top_k(x.where("id = 0"), x.withColumn("bias", F.when(F.col("id") == 3, 5.0).otherwise(0.0)), 1).first()
    assert best.id == 3
    with pytest.raises(ValueError):
        serving.top_k(x, x, 0)
    assert serving.top_k(x, x, 3, pool=x.where("id > 9")).count() == 0


@pytest.mark.parametrize("metric", serving.METRICS)
def test_tiny_and_equal_scores(spark, metric):
    """Scores near 1e-11 are ranked as they are; equal vectors, wherever they stand, are in order of ids."""
    x = np.array([[1e-6, k * 1e-5] for k in range(1, 40)])
    got = serving.top_k(table(spark, [[1e-6, 1e-6]]), table(spark, x), 3, metric, rows=8).orderBy("rank").collect()
    assert [r.id for r in got] == ([0, 1, 2] if metric == "l2" else [38, 37, 36])  # cosine divides by the lengths and 1e-8
    assert metric != "dot" or 3e-10 < got[0].score < 4e-10
    rng = np.random.default_rng(0)
    same = np.repeat(rng.normal(size=(5, 7)), 40, axis=0)[rng.permutation(200)]
    got = serving.top_k(table(spark, rng.normal(size=(9, 7))), table(spark, same), 60, metric, rows=33).orderBy("q", "rank").collect()
    for q in range(9):
        ids = [r.id for r in got if r.q == q]
        assert ids[:40] == sorted(ids[:40]) and len({tuple(same[i]) for i in ids[:40]}) == 1 and ids[40:] == sorted(ids[40:])


def test_many_seen(spark):
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(15, 4)), rng.normal(size=(60, 4))
    seen = [(a, b) for a in range(15) for b in range(60) if (a * b) % 7 < 5] + [(3, 999), (99, 1)]
    got = serving.top_k(table(spark, q), table(spark, x), 5, seen=spark.createDataFrame(seen, "q int, id int"), rows=8).orderBy("q", "rank").collect()
    s = q @ x.T
    for a, b in seen:
        if a < 15 and b < 60:
            s[a, b] = -np.inf
    want = [(a, int(b)) for a in range(15) for b in np.argsort(-s[a])[:5] if np.isfinite(s[a, b])]
    assert [(r.q, r.id) for r in got] == want


def test_most_blocks_are_skipped_where_norms_differ(spark):
    """Items whose lengths fall by powers: what the longest reach is out of reach for nearly all others."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 6)) * (np.arange(1, 4001) ** -0.7)[:, None]
    q, bias = rng.normal(size=(300, 6)), rng.normal(size=4000) * 1e-3
    items = table(spark, x).repartition(2).join(spark.createDataFrame([(i, float(b)) for i, b in enumerate(bias)], "id long, bias double"), "id")
    scored = spark.sparkContext.accumulator(0)
    seen = [(a, int(b)) for a in range(300) for b in np.argsort(-(q[a] @ x.T))[:3]]
    got = serving.top_k(table(spark, q), items, 5, seen=spark.createDataFrame(seen, "q long, id long"), rows=100, scored=scored).orderBy("q", "rank").collect()
    s = q @ x.T + bias
    for a, b in seen:
        s[a, b] = -np.inf
    assert [(r.q, r.id) for r in got] == [(a, int(b)) for a in range(300) for b in np.argsort(-s[a])[:5]]
    assert 300 * 100 <= scored.value < 0.2 * 300 * 4000


def test_nothing_asked_nothing_there(spark):
    x = table(spark, np.eye(3))
    for q, items in ((x.where("false"), x), (x, x.where("false"))):
        assert serving.top_k(q, items, 2, seen=spark.createDataFrame([(0, 1)], "q long, id long")).count() == 0


@pytest.mark.parametrize("metric", serving.METRICS)
@pytest.mark.parametrize("left_out", (False, True))
def test_equal_vectors_are_searched_once(spark, metric, left_out, monkeypatch):
    """Of 900 rows with 30 vectors: all ranks are right, though few pairs are scored; heavy queries search all items."""
    monkeypatch.setattr(serving, "LIGHT", 5)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))[rng.integers(0, 30, 900)]
    items, scored = table(spark, x).repartition(3), spark.sparkContext.accumulator(0)
    seen = [(q, int(i)) for q in range(900) for i in rng.permutation(900)[: 40 if q == 7 else q % 4]] if left_out else []
    got = serving.top_k(items, items, 6, metric, True, seen=spark.createDataFrame(seen, "q long, id long") if left_out else None, rows=50, scored=scored).orderBy("q", "rank").collect()
    out = {(q, q) for q in range(900)} | set(seen)
    for q in range(900):
        s = {"dot": x @ x[q], "cosine": x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]) + 1e-8), "l2": -((x - x[q]) ** 2).sum(1)}[metric].round(9)
        want = [int(i) for i in np.lexsort((np.arange(900), -s)) if (q, int(i)) not in out][:6]
        assert [(r.q, r.rank, r.id) for r in got[6 * q : 6 * q + 6]] == [(q, n + 1, i) for n, i in enumerate(want)]
    assert scored.value <= (900 * 30 * 12 + 900 if left_out else 30 * 30 * 7)


def test_parts_of_a_block_find_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    q, x = (serving.Side({"ids": np.arange(70).tobytes(), "vec": rng.normal(size=(70, 3)).tobytes(), "bias": np.zeros(70).tobytes()}) for _ in range(2))
    whole = serving.best(q, x, 4, "dot", True, np.array([[3, 60], [9, 2]]))
    monkeypatch.setattr(serving, "SCORES", 700)
    assert all((a == b).all() for a, b in zip(whole, serving.best(q, x, 4, "dot", True, np.array([[3, 60], [9, 2]])), strict=True))


def test_vectors_are_sent_as_often_as_the_other_side_is_cut():
    """600 blocks of half a MB on both sides: a dozen copies of all vectors, not one for each block; a bundle stays under its size."""
    per, groups = serving.tiles(600, 307 << 20, 600, 12)
    assert -(-600 // per) + groups <= 16 and per * 307 / 600 <= 64 and -(-600 // per) * groups >= 48
    per, groups = serving.tiles(6000, 3070 << 20, 6000, 12)
    assert per * 3070 / 6000 <= 64 and groups == 1
    assert serving.tiles(1, 100, 1, 8) == (1, 1) and serving.tiles(0, 0, 3, 8)[0] == 1


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_bundles_of_blocks_find_the_same(spark, metric):
    """Several blocks in a bundle, with ties across blocks, pairs left out and queries themselves."""
    rng = np.random.default_rng(5)
    x = table(spark, np.repeat(rng.normal(size=(90, 4)), 2, 0))
    seen = spark.createDataFrame([(int(q), int(i)) for q, i in rng.integers(0, 180, (400, 2))], "q long, id long")
    for left_out in (None, seen):
        one, many = ([tuple(r) for r in serving.top_k(x, x, 7, metric, True, seen=left_out, rows=rows).orderBy("q", "rank").collect()] for rows in (500, 3))
        assert one == many and len(many) == 180 * 7
