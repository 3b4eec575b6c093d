from collections import Counter
from hashlib import sha256

from millrace.llm import order_minhash as o


def test_edits(docs, texts):
    rows = o.fingerprint_edits(docs).collect()
    ordered = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(t)
        e = t[: n - n // 3] + following[: n // 3]
        want[i, n, sha256(e.encode()).hexdigest(), o.sketch(o._points(t)).tobytes().hex(), o.sketch(o._points(e)).tobytes().hex()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_many_ranges(docs, texts):
    few = o.with_next(docs, "doc_id", "text", o._found, o.FINGERPRINTS, per_range=3)
    assert few.exceptAll(o.fingerprint_edits(docs)).count() == 0 and few.count() == len(texts)


def brute(text, k):
    """Each position sorts all k-mers by a permutation of its own."""
    if not text:
        return [0] * o.SLOTS
    mask, a, b = 2**64 - 1, int(o._A), int(o._B)

    def mixed(h):
        h = ((h ^ (h >> 32)) * b) & mask
        h = ((h ^ (h >> 29)) * a) & mask
        return h ^ (h >> 32)

    seen, found, out = Counter(), [], []
    for h in o._kmers(o._points(text), min(k, len(text))).tolist():
        found.append(mixed((h + seen[h] * b) & mask))
        seen[h] += 1
    for f in o._factors(o.SLOTS).tolist():
        kept = sorted(range(len(found)), key=lambda at: ((found[at] >> 32) * f & 0xFFFFFFFF, at))[: o.TUPLE]
        m = 0
        for j, at in enumerate(sorted(kept)):
            m = mixed((m * b + found[at] + j + 1) & mask)
        out.append(max(m & 0xFFFF, 1))
    return out


def test_sketch_is_brute_force(texts):
    for _, t in texts:
        if len(t or "") < 3000:
            assert o.sketch(o._points(t or "")).tolist() == o.sketch(o._points(t or ""), some=50).tolist() == brute(t, o.K)


def test_order_matters():
    words = [f"word{k}" for k in range(300)]
    a, b = " ".join(words), " ".join(words[150:] + words[:150])
    s, near = o.sketch(o._points(a)), " ".join(words[:140] + ["other"] + words[141:])
    assert o.likeness(s, o.sketch(o._points(near))) > 0.9 > o.likeness(s, o.sketch(o._points(b)))


def test_empty(empty):
    assert o.fingerprint_edits(empty).count() == 0
