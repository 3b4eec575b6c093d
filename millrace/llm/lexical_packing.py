"""Packing by lexical retrieval (operator 7).

A sharded inverted index of token ids with BM25 weights, whose document frequencies and mean
length are counted over the whole corpus, returns the unused neighbours of seed documents.
Documents are dealt to shards by their heaviest term and, where that is frequent, their second
heaviest, so that a seed finds its neighbours in its own shard at any size of the corpus. A
shard's documents first give whole windows of their own; of the rest, the longest unused one
seeds a window, the index ranks all unused documents against the seed, and they fill the window
greedily: those that fit whole first, and the best ranked of the others is cut to fill the room
that is left. Only a shard's last window can be short.

Hot terms: a term that could gather more than a part of a shuffle partition (its document
frequency times the mean length) is dealt to as many groups, by the second term, and that one
in turn by the row's number in its task; so copies of one text are dealt out as well. A task
reads its groups in order and makes a shard of each ``shard_tokens`` tokens, the last document
whole: what it holds is bounded by that and the longest document.

Null text: only the end id. Repeated rows are packed each. Null ids stay null. Documents
of any length are cut into windows. Empty table: empty result. Extra columns are ignored.
Tokens are written once to the shared folder, and no state is shared between shards.
"""

from collections.abc import Iterator
from itertools import repeat
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.word_tokens import terms, tokens, width
from millrace.llm.work import parts, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
K1, B = 1.2, 0.75


def weights(ids: list[np.ndarray], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, term and BM25 weight of the terms that weigh something, by document and term."""
    small = len(ids) < 1 << 16 and all(x.dtype.itemsize == 2 for x in ids[:1])
    doc, term, tf = terms(ids, np.dtype(np.uint32 if small else np.uint64))
    keep = idf[term] > 0
    doc, term, tf = doc[keep], term[keep], tf[keep]
    length = np.fromiter(map(len, ids), np.float64, len(ids))
    return doc, term, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))


def heaviest(ids: list[np.ndarray], idf: np.ndarray, mean: float) -> np.ndarray:
    """The two heaviest terms of each document, the smaller of equals first; -1 for none."""
    doc, term, weight = weights(ids, idf, mean)
    out = np.full((2, len(ids)), -1, np.int64)
    for k in range(2):
        if not len(doc):
            break
        head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        top = np.maximum.reduceat(weight, head)
        best = np.flatnonzero(weight == np.repeat(top, np.diff(np.append(head, len(doc)))))
        best = best[np.concatenate(([True], doc[best][1:] != doc[best][:-1]))]
        out[k, doc[best]] = term[best]
        rest = np.ones(len(doc), bool)
        rest[best] = False
        doc, term, weight = doc[rest], term[rest], weight[rest]
    return out


class Index:
    """BM25 over a shard: postings by term, ranked against one document at a time."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        doc, self.term, weight = weights(ids, idf, mean)
        self.n, self.bounds = len(ids), np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.argsort(self.term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        present, self.first = np.unique(self.term[order], return_index=True)
        self.size = np.diff(np.append(self.first, len(order)))
        self.row = np.searchsorted(present, self.term)

    def scores(self, k: int) -> np.ndarray:
        """Of all documents, for the terms of document ``k``."""
        rows = self.row[self.bounds[k] : self.bounds[k + 1]]
        size = self.size[rows]
        at = np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    out, sequence = [], 0
    for d in np.flatnonzero(n >= window).tolist():
        for start in range(0, int(n[d]) - window + 1, window):
            out.append((d, start, window, sequence, 0))
            sequence += 1
    at = n - n % window
    left = n - at
    index = Index(ids, idf, mean) if len(ids) else None
    for seed in np.argsort(-left, kind="stable").tolist():
        if not left[seed]:
            continue
        offset = 0

        def put(d: int) -> None:
            nonlocal offset
            take = int(min(left[d], window - offset))
            out.append((d, int(at[d]), take, sequence, offset))  # noqa: B023
            at[d] += take
            left[d] -= take
            offset += take

        put(seed)
        if offset < window:
            unused, scores = np.flatnonzero(left), index.scores(seed)
            scores = scores[unused]
            near, none = np.flatnonzero(scores > 0), np.flatnonzero(scores <= 0)
            ranked = unused[np.concatenate((near[np.argsort(-scores[near], kind="stable")], none))]
            sizes, k = left[ranked], 0
            while len(fit := np.flatnonzero(sizes[k:] <= window - offset)):  # the best ranked of those that fit whole
                k += int(fit[0])
                room = np.cumsum(sizes[k : k + window - offset])  # and those behind it as long as they fit
                n_fit = int(np.searchsorted(room, window - offset, "right"))
                some, starts = ranked[k : k + n_fit], offset + room[:n_fit] - sizes[k : k + n_fit]
                out.extend(zip(some.tolist(), at[some].tolist(), left[some].tolist(), repeat(sequence), starts.tolist()))
                offset += int(room[n_fit - 1])
                at[some] += left[some]
                left[some] = 0
                k += n_fit
                if offset == window:
                    break
            if offset < window and len(rest := np.flatnonzero(left[ranked])):
                put(int(ranked[rest[0]]))
        sequence += 1
    return out


def dealt(rows: DataFrame, idf: np.ndarray, df: np.ndarray, mean: float, kind: str, grain: float) -> DataFrame:
    """``rows`` with first, salt and second: the heaviest terms, and the group of a term that gathers more than ``grain`` tokens."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, df))  # one number for each id of the vocabulary

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        idf, df = shared.value
        most = np.maximum(1, np.ceil(df * (mean / grain))).astype(np.int64)  # term -1 is the last: all documents
        mixed = np.array([xxh64_intdigest(int(t).to_bytes(4, "little")) >> 1 for t in range(len(df))], np.int64)
        seen = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                first, second = heaviest([np.frombuffer(x, kind) for x in part.column(1).to_pylist()], idf, mean)
                number = seen + np.arange(part.num_rows)
                seen += part.num_rows
                salts = most[first]
                salt = (mixed[second] % salts + number % np.minimum(salts, most[second])) % salts
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in (first, salt, second))], ["doc_id", "ids", "first", "salt", "second"])

    return rows.select("doc_id", "ids").mapInArrow(task, "doc_id long, ids binary, first long, salt long, second long")


def pack(docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", window: int = 4096, shard_tokens: int = 1 << 19) -> DataFrame:
    """Pieces of all documents: the columns of PIECES, whose sequence_id is the task's number times 2**32 and a count."""
    rows, kind, n_parts = written(tokens(docs, tokenizer, ident, text), "tokens"), width(tokenizer), parts(docs)
    counted = rows.where("terms IS NOT NULL")
    total = counted.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    each = counted.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    found = each.toArrow()  # one row for each id of the vocabulary at most: bounded by the tokenizer, not by the corpus
    df = np.zeros(2 + max(found["terms"].to_pylist(), default=0))
    df[found["terms"].to_numpy()] = found["df"].to_numpy()
    df[-1] = total.docs
    # terms of more than half of all documents weigh nothing
    idf = np.maximum(0.0, np.log((total.docs - df + 0.5) / (df + 0.5))).astype(np.float32)
    mean = total.tokens / max(1, total.docs)
    grain = max(window, min(shard_tokens, total.tokens / (4 * n_parts)))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        doc_ids, raw, size = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            ids = [np.frombuffer(x, kind) for x in raw]
            pieces = pack_shard(ids, shared.value, mean, window)
            d, start, length, own, offset = (np.array([p[k] for p in pieces], np.int64) for k in range(5))
            crc = [crc32(ids[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes()) for p in pieces]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            cols = [pa.array(doc_ids, pa.int64()).take(pa.array(d)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[d], sequence + own, offset))]
            sequence += int(own.max()) + 1
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for ident_, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(ident_)
                raw.append(x)
                size += len(x) // np.dtype(kind).itemsize
                if size >= shard_tokens:
                    yield packed()
                    doc_ids, raw, size = [], [], 0
        if raw:
            yield packed()

    groups = dealt(rows.where("ids IS NOT NULL"), idf, df, mean, kind, grain).repartition(n_parts, "first", "salt")
    return groups.sortWithinPartitions("first", "salt", "second", "doc_id", "ids").select("doc_id", "ids").mapInArrow(shards, PIECES)
