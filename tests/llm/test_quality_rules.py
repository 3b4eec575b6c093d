import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import quality_rules as q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(wins)
    covered = {k + d for k, x in enumerate(wins) if n[x] > 1 for d in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures(docs, texts):
    rows = q.judge(q.ledger(docs), "2026-1").collect()
    assert len(rows) == len(texts)
    got = Counter((r.doc_id, *(r[m] for m in q.MEASURES)) for r in rows)
    assert got == Counter((i, *brute(t)) for i, t in texts)
    for r in rows:
        n, _, symbols, lines, dup, again = brute(r.text)
        assert bool(r.failed_bits & 3) == (n < 20 or 100 * again > 30 * n)
        assert r.kept == (r.failed_bits == 0)
        assert r.key == "k"


def test_filter_and_ablations(docs):
    rows = q.ledger(docs)
    kept = q.judge(rows, "base").where("kept").count()
    found = {r.rule: r for r in q.ablations(rows, "base").collect()}
    assert found["few_words"].n_kept == kept
    only = rows.where("failed_bits & 3 = 1").count()
    assert found["few_words"].n_only == only and found["few_words"].n_kept_without == kept + only


def test_empty(empty):
    assert q.judge(q.ledger(empty), "base").count() == 0
    assert q.ablations(q.ledger(empty).withColumn("x", F.lit(1)), "base").count() == 0
