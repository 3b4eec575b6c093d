import re
from itertools import permutations

from oracle import compare

from millrace.llm import filter_audit
from millrace.llm.queries import OP11_SQL, op11_filter_audit


def brute(rows, labels):
    """rows: (doc_id, text, lang). Every order is applied as it stands."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    failed = []
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", t) if x]
        same = [(j is None, j) for j, s, _ in rows if (s or "") == t]
        smaller = any((not none and (i is None or j < i)) for none, j in same)
        failed.append({f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), smaller), strict=True) if bad})
    out = {}
    for part in {p or "" for *_, p in rows}:
        at = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = at
            for step, f in enumerate(order):
                gone = [k for k in left if f in failed[k]]
                left = [k for k in left if f not in failed[k]]
                share[f] += len(gone)
                late = sum(f in failed[k] for k in at) - len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), late, sum(failed[k] == {f} for k in at), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = share[out[key][6]]
    return out


def test_against_brute_force(spark, docs, texts):
    langs = ["en", None, "", "de", "en"]
    more = [(7, "A B C " * 50), (7, "A B C " * 50), (8, "A B C " * 50), (None, "A B C " * 50), (7, "$"), (None, "nowhere else"), (None, "nowhere else"), (500, " ".join(f"w{k}" for k in range(120)))]
    rows = [(i, t, langs[k % 5]) for k, (i, t) in enumerate(texts + more)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60)] + [(3, None, None), (5, 1, 0), (7, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "doc_id long, text string, lang string, n long, part string, pattern int")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 120 * 5 * 3
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_no_documents(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_query_matches_sql(spark):
    compare(spark, op11_filter_audit, OP11_SQL)
