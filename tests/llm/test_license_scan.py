import random

import pytest

from millrace.llm import license_scan as s


def test_scan(spark, docs, empty):
    mit = s.TEMPLATES["MIT-text"]
    rows = [(1, f"Some text. {mit.upper()} More."), (2, "Released under the MIT License."), (3, None), (4, mit + " " + mit), (5, "mit " * 50 + "released the license")]
    got = {r.doc_id: r for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license == "MIT-text" and got[1].coverage == 1.0 and got[1].first_word == 2
    assert got[2].license == "MIT" and got[2].licenses == ["MIT"]
    assert got[3].license is None and got[3].n_words == 0
    assert got[4].license == "MIT-text" and got[5].license is None
    assert s.scan(empty).count() == 0 and s.scan(docs).count() == docs.count()
    with pytest.raises(ValueError):
        s.Scanner({"none": " "}, 0.8)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_align_is_increasing_and_near_lcs():
    rng = random.Random(0)
    for _ in range(50):
        b = [str(rng.randint(0, 60)) for _ in range(40)]
        a = [w for w in b if rng.random() > 0.1]
        for _ in range(5):
            a.insert(rng.randint(0, len(a)), str(rng.randint(0, 60)))
        pairs = s.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) >= 0.85 * lcs(a, b)


def test_longest_run_is_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(70, 120))] for _ in range(2))
        x, y, n = s.longest_run(a, b)
        best = max(k for i in range(len(a)) for j in range(len(b)) for k in [next((k for k in range(len(a)) if a[i : i + k + 1] != b[j : j + k + 1] or i + k >= len(a) or j + k >= len(b)), 0)])
        assert n == best and a[x : x + n] == b[y : y + n] and not any(a[i : i + n] == b[j : j + n] for i in range(x) for j in range(len(b)))


def test_surroundings_of_any_length_hide_nothing():
    """Notices among words of their own vocabulary, however many; brute force tries every stretch of a short text."""
    rng, scanner = random.Random(6), s.Scanner({"MIT-text": s.TEMPLATES["MIT-text"]}, 0.8)
    own = s.words(s.TEMPLATES["MIT-text"])
    for n in (50, 2000, 30_000):
        noise = lambda: " ".join(rng.choices(own, k=n))  # noqa: B023, E731
        _, found = scanner(f"{noise()} {' '.join(own)} {noise()} {' '.join(own)} {noise()}")
        assert [(c, name) for c, name, _, _ in found] == [(1.0, "MIT-text")], n
    most, need = int(1.5 * len(own)), 0.8 * len(own)
    for _ in range(30):
        kept = [w if rng.random() > 0.18 else "zzz" for w in own for _ in range(1 + (rng.random() < 0.05))]
        text = rng.choices(own + ["qq"] * 40, k=60) + kept + rng.choices(own + ["qq"] * 40, k=60)
        brute = max(lcs(text[k : k + most], own) for k in range(len(text)))
        _, found = scanner(" ".join(text))
        assert not found or found[0][0] <= brute / len(own)
        assert found or brute < need + 0.1 * len(own)


def test_whole_licenses():
    scanner = s.Scanner(s.TEMPLATES, 0.8)
    for name, text in s.TEMPLATES.items():
        found = scanner("Some words before. " * 300 + text + " And after." * 300)[1]
        assert (1.0, name) in [x[:2] for x in found]
    edited = s.words(s.TEMPLATES["MIT-full"])
    del edited[40:50]
    assert scanner(" ".join(edited))[1][0][1] in ("MIT-full", "MIT-text") and any(x[1] == "MIT-full" and x[0] > 0.9 for x in scanner(" ".join(edited))[1])
