import random
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import source_mix as m


def test_targets():
    sizes = {"b": 100, "a": 1000, None: 10, "c": 0}
    goal = m.targets(sizes)
    assert abs(sum(goal.values()) - 1.5 * 1110) < 1e-9
    assert all(goal[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert m.targets({}) == {}


def test_flow_moves_shared_words():
    given = m.flow({("a",): 10, ("a", "b"): 10, ("b",): 0}, {"a": 15, "b": 5}, 2)
    assert given[("a",), "a"] + given[("a", "b"), "a"] == 15 and given[("a", "b"), "b"] == 5
    # b can only be served by the shared pattern, a gives way
    given = m.flow({("a", "b"): 10, ("a",): 10}, {"a": 10, "b": 10}, 1)
    assert given[("a", "b"), "b"] == 10 and given[("a",), "a"] == 10


def test_mix(docs, texts):
    rows, sizes, goal = m.mix_by_source(docs)
    got = rows.collect()
    assert len(got) == len(texts)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").replace("\x0b", " ").encode().split())) for i, t in texts)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = m.mix_by_source(docs.repartition(3))[0]
    assert again.drop("taken_for").exceptAll(rows.drop("taken_for")).count() == 0


def test_overlapping_sources(spark):
    rows = [(k, ["a"] if k % 3 else ["a", "b"], 7) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    out, sizes, goal = m.mix(df, quotas=lambda sizes: {"a": 900.0, "b": 1200.0})
    words = out.select(F.explode("taken_for").alias("t")).groupBy("t.source").agg(F.sum("t.words").alias("n"))
    assert {r.source: r.n for r in words.collect()} == {"a": 900, "b": 1200}
    assert out.where("taken > 2 * size").count() == 0


def test_empty(empty):
    assert m.mix_by_source(empty)[0].count() == 0


def cheapest(patterns, quotas, repeats):
    """Most words and least cost by single words along shortest paths of the explicit network (Bellman-Ford)."""
    edges = []  # from, to, room, cost; an edge and its reverse stand side by side

    def edge(a, b, room, cost):
        edges.append([a, b, room, cost])
        edges.append([b, a, 0, -cost])

    for p, n in patterns.items():
        for k in range(repeats):
            edge("start", ("p", p), n, k)
        for s in p:
            if s in quotas:
                edge(("p", p), ("s", s), 10**6, 0)
    for s, q in quotas.items():
        edge(("s", s), "end", q, 0)
    words = cost = 0
    while True:
        far, came = {"start": 0}, {}
        for _ in range(len(edges)):
            changed = False
            for k, (a, b, room, c) in enumerate(edges):
                if room and a in far and far[a] + c < far.get(b, 10**9):
                    far[b], came[b], changed = far[a] + c, k, True
            if not changed:
                break
        if "end" not in far:
            return words, cost
        at = "end"
        while at != "start":
            k = came[at]
            edges[k][2] -= 1
            edges[k ^ 1][2] += 1
            at = edges[k][0]
        words, cost = words + 1, cost + far["end"]


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        sources = ["a", "b", "c", None][: rng.randint(1, 4)]
        patterns = {tuple(s for s in sources if rng.random() < 0.6): rng.randint(0, 9) for _ in range(rng.randint(1, 5))}
        quotas = {s: rng.randint(0, 14) for s in sources}
        repeats = rng.randint(1, 3)
        given = m.flow(patterns, quotas, repeats)
        used = {p: sum(n for (q, _), n in given.items() if q == p) for p in patterns}
        assert all(n >= 0 for n in given.values()) and all(used[p] <= repeats * n for p, n in patterns.items())
        assert all(sum(n for (_, s), n in given.items() if s == t) <= q for t, q in quotas.items())
        cost = sum(k * max(0, min(used[p], (k + 1) * n) - k * n) for p, n in patterns.items() for k in range(repeats))
        assert (sum(used.values()), cost) == cheapest(patterns, quotas, repeats)
