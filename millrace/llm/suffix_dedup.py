"""Exact passage dedup by a run-length Burrows-Wheeler index (operator 9).

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a
smaller id is removed; matches are judged on the input and never cross documents.

Strings that could match are brought together first: each one is keyed by the least hashed
k-gram inside it (its minimizer), which equal strings share. Texts are dealt to buckets once,
in a table bucketed in the shared folder, and then:

1. each bucket sends the distinct keys of its texts to shards by key;
2. a shard answers which keys occur in several documents, a bit for each;
3. buckets send, for those keys, the distinct contexts (the bytes around the k-gram that hold
   all its strings) with the smallest document of each;
4. a shard joins equal contexts and builds a ``RunIndex`` over those that share a key with
   others, ordered by document; walking its runs marks strings owned by a smaller document;
5. buckets apply the marks.

Repeats within a bucket are joined before anything is sent, so a copy that holds a third of all rows
costs one entry for each bucket. What a shard holds is distinct contexts only. A key that occurs more than
``HOT`` times, such as that of a common phrase in ever different surroundings, is not brought together:
each string around it goes to the shard of its own 64-bit hash, where the smallest document is found by
sorting. So an index has at most ``HOT`` contexts of a key, and no key needs one task.

Null text: empty. Null id: larger than any other. Rows of equal id don't clean each other.
Texts under LENGTH bytes stay. Empty table: empty result. Extra columns are ignored by
``removals``; ``cleaned`` keeps the columns and replaces the text.
"""

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.llm.exchange import KEY_BITS, SIDE, bucketed, cut_by_shard, gathered, shared, shared_keys
from millrace.llm.run_index import RunIndex
from millrace.llm.work import written

LENGTH = 50
KGRAM = 24
STRINGS = LENGTH - KGRAM + 1  # of LENGTH bytes around a k-gram
WIDTH = LENGTH + STRINGS - 1
#: Occurrences of a key beyond which its strings are dealt by their own hash.
HOT = 8192
NUL, PAD = 0xFE, 0xFF  # bytes that UTF-8 never has
LAST = np.iinfo(np.int64).max
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


class Bucket:
    """Texts of a bucket one after the other, with the keys of all their strings."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.texts = texts
        self.ids = np.array([LAST if x is None else x for x in ids], np.int64)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.data = np.where(data == 0, np.uint8(NUL), data)
        # strings that start at ``first`` to ``last`` have their minimizer at ``pos``; parts cut some such runs in two
        parts = [self._some(a, min(a + (1 << 16), len(data) - LENGTH + 1)) for a in range(0, len(data) - LENGTH + 1, 1 << 16)]
        none = (np.zeros(0, np.int64),) * 4
        self.pos, self.first, self.last, self.key = (np.concatenate(x) for x in zip(none, *parts, strict=True))
        self.doc = np.searchsorted(self.ends, self.first, "right")

    def _some(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """pos, first, last and key of the strings that start at a to b."""
        with np.errstate(over="ignore"):
            part, size, power, h, done, k = self.data[a : b + LENGTH - 1].astype(np.uint64), 1, _A, None, 0, KGRAM
            n = b - a + LENGTH - KGRAM
            while k:
                if k & 1:
                    h = part[done : done + n].copy() if h is None else h * power + part[done : done + n]
                    done += size
                k >>= 1
                if k:
                    part = part[:-size] * power + part[size:]
                    size, power = 2 * size, power * power | np.uint64(1)
            h = (h ^ (h >> np.uint64(32))) * _B
            h ^= h >> np.uint64(29)
            h *= _A
        # the hash above the place: of equal hashes the first wins
        h = (h >> np.uint64(64 - KEY_BITS) << np.uint64(64 - KEY_BITS)) | np.arange(n, dtype=np.uint64)
        least, size = h, 1
        while 2 * size <= STRINGS:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = STRINGS - size
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        start = np.arange(a, b)
        doc = np.searchsorted(self.ends, a, "right")
        inside = np.ones(b - a, bool)
        while doc < len(self.ends) and self.ends[doc] - LENGTH + 1 < b:  # strings over the end of a text
            inside[max(0, self.ends[doc] - LENGTH + 1 - a) : max(0, self.ends[doc] - a)] = False
            doc += 1
        new = np.ones(b - a, bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        end = np.ones(b - a, bool)
        end[:-1] = new[1:] | ~inside[1:]
        at = np.flatnonzero(new & inside)
        least = least[at]
        return a + (least & np.uint64(0xFFFFFF)).astype(np.int64), start[at], start[end & inside], (least >> np.uint64(64 - KEY_BITS)).astype(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, which of them several ids have, and how often each occurs."""
        order = np.lexsort((self.ids[self.doc], self.key))
        key, owner = self.key[order], self.ids[self.doc[order]]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(key))
        return key[heads], owner[heads] != owner[ends - 1] if len(key) else np.zeros(0, bool), ends - heads


class Strings:
    """The strings of a bucket's occurrences of hot keys (sorted), joined by their hash: each goes to the shard of its own hash."""

    def __init__(self, bucket: Bucket, hot: np.ndarray):
        b, at = bucket, np.flatnonzero(np.isin(bucket.key, hot))
        n = b.last[at] - b.first[at] + 1
        self.start = np.repeat(b.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        owner = np.repeat(b.ids[b.doc[at]], n)
        windows = np.lib.stride_tricks.sliding_window_view(b.data, LENGTH) if len(at) else None
        some = [row_hash(windows[self.start[k : k + 100_000]]) for k in range(0, len(self.start), 100_000)]
        h = np.concatenate([np.zeros(0, np.uint64), *some])
        order = np.lexsort((owner, h))
        new = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, bool)
        heads = order[new]
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.hash, self.owner = h[heads], owner[heads]
        self.later = owner > self.owner[self.of]

    def starts(self, smaller: np.ndarray) -> np.ndarray:
        """Places of strings that a smaller document has; ``smaller``: which of the joined ones have one elsewhere."""
        return self.start[self.later | smaller[self.of]]


class Contexts:
    """Distinct contexts of a bucket's occurrences of ``known`` keys (sorted), by key."""

    def __init__(self, bucket: Bucket, known: np.ndarray):
        if len(known):
            at = np.searchsorted(known, bucket.key)
            self.at = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == bucket.key)
        else:
            self.at = np.zeros(0, np.int64)
        b, at = bucket, self.at
        self.left = b.pos[at] - STRINGS + 1
        start = np.concatenate(([0], b.ends[:-1]))[b.doc[at]] if len(at) else self.left
        end = b.ends[b.doc[at]] if len(at) else self.left
        data = np.concatenate((np.full(WIDTH, PAD, np.uint8), b.data, np.full(WIDTH, PAD, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[self.left + WIDTH]
        place = self.left[:, None] + np.arange(WIDTH)
        rows = np.where((place >= start[:, None]) & (place < end[:, None]), rows, np.uint8(PAD))
        span = np.stack((b.first[at] - self.left, b.last[at] - self.left), axis=1).astype(np.uint8)
        entry = np.ascontiguousarray(np.concatenate((rows, span), axis=1))
        h = row_hash(entry)
        owner = b.ids[b.doc[at]]
        order = np.lexsort((owner, h, b.key[at]))
        k, o = b.key[at][order], h[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))) if len(at) else np.zeros(0, bool)
        heads = order[new]
        self.of = np.empty(len(at), np.int64)  # the entry of each occurrence
        self.of[order] = np.cumsum(new) - 1
        self.key, self.entry, self.owner = b.key[at][heads], entry[heads], owner[heads]
        self.later = owner > self.owner[self.of]


def row_hash(rows: np.ndarray) -> np.ndarray:
    """64 bits of each row of bytes."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for column in wide.view("<u8").T:
            h = (h ^ column) * _A
            h ^= h >> np.uint64(29)
            h *= _B
            h ^= h >> np.uint64(32)
    return h


def marks(key: np.ndarray, entry: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each context: bits of its strings that a smaller owner has."""
    n = len(key)
    out = np.zeros(n, np.uint32)
    if not n:
        return out
    h = row_hash(entry)
    order = np.lexsort((owner, h, key))
    k, o = key[order], h[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
    kind = np.cumsum(new) - 1
    heads = order[new]
    least = owner[heads]
    span = entry[:, WIDTH:].astype(np.uint32)
    all_bits = (np.uint32(2) << span[:, 1]) - (np.uint32(1) << span[:, 0])
    smaller = owner[order] > least[kind]
    out[order] = np.where(smaller, all_bits[order], 0)
    # of each kind of context the smallest owner: only those that share their key with other kinds can match
    kk = key[heads]
    other = np.zeros(len(kk), bool)
    same = kk[1:] == kk[:-1]
    other[1:] |= same
    other[:-1] |= same
    reps = np.flatnonzero(other)
    of = np.zeros(len(heads), np.uint32)
    column = np.arange(STRINGS)
    for some in _by_key(reps, kk[reps]):
        some = some[np.argsort(least[some], kind="stable")]
        rows, own = entry[heads[some]], least[some]
        valid = np.zeros((len(some), WIDTH + 1), bool)
        valid[:, :STRINGS] = (column >= rows[:, WIDTH, None]) & (column <= rows[:, WIDTH + 1, None])
        found = RunIndex(rows[:, :WIDTH], own, valid, LENGTH).owners(STRINGS)
        of[some] = ((found < own[:, None]) & valid[:, :STRINGS]) @ (np.uint32(1) << column.astype(np.uint32))
    out[order] |= np.where(smaller, 0, of[kind]).astype(np.uint32)
    return out


def smaller(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which rows have a smaller owner of the same key."""
    order = np.lexsort((owner, key))
    head = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    out = np.empty(len(key), bool)
    out[order] = owner[order] > np.repeat(owner[order][head], np.diff(np.append(head, len(key))))
    return out


def _by_key(rows: np.ndarray, key: np.ndarray, size: int = 8192) -> Iterator[np.ndarray]:
    """``rows`` in parts of about ``size``, for an index each; no key is in two parts."""
    heads = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key)) if len(key) else np.zeros(1, int)
    start = 0
    for head in heads[1:].tolist():
        if head - start >= size or head == len(key):
            yield rows[start:head]
            start = head


def removed(bucket: Bucket, contexts: Contexts, mark: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Of the bucket's bytes: those to remove. ``more``: further strings, by where they start."""
    b, at = bucket, contexts.at
    starts = np.zeros(len(b.data) + 1, np.int64)
    full = at[contexts.later]
    np.add.at(starts, b.first[full], 1)
    np.add.at(starts, b.last[full] + 1, -1)
    hit = np.cumsum(starts[:-1]) > 0
    some = np.flatnonzero(~contexts.later)
    bits = mark[contexts.of[some]]
    for column in range(STRINGS):
        hit[contexts.left[some[bits >> np.uint32(column) & 1 == 1]] + column] = True
    hit[more] = True
    begun = np.concatenate(([0], np.cumsum(hit)))
    before = np.maximum(np.arange(len(hit)) - LENGTH + 1, 0)
    return begun[1:] > begun[before]


def _texts(table: pa.Table) -> Bucket:
    table = table.sort_by([("doc_id", "ascending"), ("t", "ascending")])
    return Bucket(table["doc_id"].to_pylist(), table["t"].to_pylist())


def _marked(docs: DataFrame, ident: str, text: str, emit, schema, more: list[str] = ()) -> DataFrame:
    """``emit(bucket, removed bytes)``, a table, of every bucket."""
    full, n = bucketed(docs, ident, text, more)
    texts = full.select("bucket", "doc_id", "t")

    def send_contexts(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Contexts by key, then strings of hot keys (without entries) by hash."""
        bucket = _texts(table)
        known, hot = shared_keys(bucket, answers)
        at, tables = table["bucket"][0].as_py(), []
        c, s = Contexts(bucket, known[~hot]), Strings(bucket, known[hot])
        for key, of, entry, owner in ((c.key, c.key, c.entry, c.owner), (s.hash.view(np.int64), (s.hash >> np.uint64(64 - KEY_BITS)).astype(np.int64), None, s.owner)):
            shard, cut = cut_by_shard(of, n)
            blob = lambda x, kind: pa.array([y.astype(kind).tobytes() for y in cut(x)], pa.binary())  # noqa: B023, E731
            entries = pa.nulls(len(shard), pa.binary()) if entry is None else blob(entry, "u1")
            tables.append(pa.table({"bucket": pa.array([at] * len(shard), pa.int32()), "shard": pa.array(shard, pa.int32()), "keys": blob(key, "<i8"), "entries": entries, "owners": blob(owner, "<i8")}))
        return pa.concat_tables(tables)

    def mark(table: pa.Table) -> pa.Table:
        tables = []
        for strings in (False, True):
            some = table.filter(pa.compute.equal(pa.compute.is_null(table["entries"]), strings))
            if not some.num_rows:
                continue
            get = lambda name, kind: [np.frombuffer(x, kind) for x in some[name].to_pylist()]  # noqa: B023, E731
            keys, owner = get("keys", "<i8"), np.concatenate(get("owners", "<i8"))
            key = np.concatenate(keys)
            out = smaller(key, owner) if strings else marks(key, np.concatenate(get("entries", "u1")).reshape(-1, WIDTH + 2), owner)
            cut = np.split(out, np.cumsum([len(k) for k in keys])[:-1])
            tables.append(pa.table({"bucket": some["bucket"], "shard": some["shard"], "marks": pa.array([x.astype("u1" if strings else "<u4").tobytes() for x in cut], pa.binary()), "strings": pa.array([strings] * some.num_rows)}))
        return pa.concat_tables(tables)

    def apply(table: pa.Table, sides: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("t", "ascending")])
        bucket = _texts(table)
        known, hot = shared_keys(bucket, sides.filter(pa.compute.is_valid(sides["shared"])))
        got, of = (gathered(sides.filter(pa.compute.equal(sides["strings"], kind)), "marks", "u1" if kind else "<u4") for kind in (False, True))
        return emit(table, bucket, removed(bucket, Contexts(bucket, known[~hot]), got, Strings(bucket, known[hot]).starts(of.astype(bool))))

    answers = shared(texts, _texts, n, HOT)
    found = texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(send_contexts, f"{SIDE}, keys binary, entries binary, owners binary")
    marked = written(found.groupBy("shard").applyInArrow(mark, f"{SIDE}, marks binary, strings boolean"), "marks")
    sides = answers.unionByName(marked, allowMissingColumns=True)
    return full.groupBy("bucket").cogroup(sides.groupBy("bucket")).applyInArrow(apply, schema)


def _each(bucket: Bucket, gone: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
    """Kept bytes, removed bytes and removed runs of each text."""
    start = 0
    for text, end in zip(bucket.texts, bucket.ends.tolist(), strict=True):
        own = gone[start:end]
        if own.any():
            runs = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
            yield np.frombuffer(text, np.uint8)[~own].tobytes(), int(own.sum()), runs
        else:
            yield text, 0, 0
        start = end


def removals(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""

    def emit(table: pa.Table, bucket: Bucket, gone: np.ndarray) -> pa.Table:
        rows = list(_each(bucket, gone))
        return pa.table({
            "doc_id": table["doc_id"], "n_bytes": pa.array(bucket.sizes, pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()),
            "n_spans": pa.array([r[2] for r in rows], pa.int64()), "kept_sha256": pa.array([sha256(r[0]).hexdigest() for r in rows], pa.string()),
        })

    return _marked(docs, ident, text, emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what stays of each text (broken characters at cuts left out) and ``n_removed`` bytes."""
    more = [c for c in docs.columns if c not in (text, "n_removed")]
    schema = StructType([StructField(c, docs.schema[c].dataType) for c in more] + [StructField(text, StringType()), StructField("n_removed", LongType())])

    def emit(table: pa.Table, bucket: Bucket, gone: np.ndarray) -> pa.Table:
        rows = list(_each(bucket, gone))
        cols = {c: table[f"x{k}"] for k, c in enumerate(more)}
        return pa.table(cols | {text: pa.array([r[0].decode(errors="ignore") for r in rows], pa.string()), "n_removed": pa.array([r[1] for r in rows], pa.int64())})

    return _marked(docs, ident, text, emit, schema, more)
