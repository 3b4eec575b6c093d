from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from oracle import SF
from pyspark.sql import functions as F

from millrace.llm import merkle
from millrace.llm.queries import op13_merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree(nodes):
    """The root and, of each node, what stands beside it level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = range(a - a % 3, min(a - a % 3 + 3, len(nodes)))
            proofs[k].append(([nodes[x] for x in run if x < a], [nodes[x] for x in run if x > a]))
        nodes, at = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], [a // 3 for a in at]
    return nodes[0], proofs


def brute(rows):
    by_source = defaultdict(list)
    for doc_id, source, lang, n, text in rows:
        seen = text.replace("\n", "") if text and doc_id is not None and crc32(str(doc_id).encode()) % 2 == 0 else text
        by_source[source].append((doc_id is None, doc_id or 0, leaf(doc_id, source, lang, n, text), doc_id, leaf(doc_id, source, lang, n, seen)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources]) if sources else (None, [])
    out = Counter()
    for s, top in zip(sources, tops, strict=True):
        for x, way in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            found = x[4]
            for left, right in way + top:
                found = h(*left, found, *right)
            out[x[3], x[2], trees[s][0], root, h(*[y for left, right in way + top for y in left + right]), found, found == root] += 1
    return out


def table(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("span", [1, 2, 6])
def test_against_brute_force(spark, docs, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    more = [(900 + k, f"s{k}", None, None, "\n\nx") for k in range(7)] + [(k, "", "en", 2, f"line {k}\nline") for k in range(100)] + [(5, "Ü", "en", 0, "")] * 5
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, source string, lang string, n_chars long, text string"), allowMissingColumns=True)
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in df.collect()]
    got = table(merkle.manifest(df))
    assert got == brute(rows)
    changed = {r[0] for r in rows if r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")}
    assert {x[0] for x in got if not x[6]} == changed


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 28])
def test_small(spark, empty, n):
    rows = [(k, "a", "en", 1, "t\n") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert table(merkle.manifest(df)) == brute(rows)
    if not n:
        assert merkle.manifest(empty).count() == 0


def test_query(spark):
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = op13_merkle(spark, SF)
    assert table(df) == brute(rows) and df.where(F.col("source").isNotNull()).count() > 0
