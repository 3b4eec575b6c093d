import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, bucket string"


def words(rng, n, pool):
    return [rng.choice(pool) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: near and exact copies, shared passages, repeats, nulls, a long text, odd bytes, repeated rows."""
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(words(rng, rng.randint(5, 150), pool)) for _ in range(40)]
    passage = " ".join(words(rng, 70, pool))
    out = list(base)
    out += [base[3], base[3], base[5] + " end", base[7].upper()]
    out += [f"{base[k]} {passage} {base[k + 1]}" for k in range(10, 14)]
    edited = passage.split()
    for k in range(9, 70, 14):
        edited[k] = "changed"
    out += [f"{base[20]} {' '.join(edited)} {base[21]}", " ".join(words(rng, 8, pool)) * 1 + ("\n" + base[2]) * 5]
    out += [None, "", " \t\n", "a", "nul\x00byte " * 20, "nul\x00byte " * 20, "日本語 " * 40, " ".join(words(rng, 20_000, pool)), ("the same line\n" * 60)]
    rows = list(enumerate(out))
    return rows + [rows[4], (None, base[6]), (None, None), (2**40, base[9])]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names clash with those that operators make."""
    sources = ["a", "b", None, "c", "a", "a"]
    rows = [(i, t, "en", sources[k % 6], None if t is None else len(t), "k", "s", "b") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
