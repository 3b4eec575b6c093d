"""Order MinHash fingerprints (operator 2).

A text's k-mers of code points are numbered by occurrence, so that all differ, and hashed.
Each of ``slots`` positions of the signature has a permutation of its own: the ``tuple_size``
least k-mers under it are kept in text order and hashed as a tuple. Moving a passage changes
tuples though the set of k-mers stays, so likeness, the share of equal positions, follows edit
distance and not set overlap alone.

Texts shorter than k are one k-mer; null and empty texts have none: they are alike (1.0) to
each other and unlike (0.0) any other. Equal texts have equal fingerprints.

``with_next`` pairs each row with the next in order of descending ids without a global sort:
ids are cut into ranges by approximate quantiles, and the top row of a range is copied into
the range before. Ids may be null (last) or repeat (then by text); a hash shuffle moves each
text once. Rows of one id are in one range, which is read as a stream; repeated texts are hashed
once. Extra columns are ignored; an empty table gives an empty table; a lone row is its own next.
"""

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256
from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.work import parts

K, SLOTS, TUPLE = 8, 64, 2
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def _kmers(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers, from those of lengths that are powers of two."""
    n = len(points) - k + 1
    part, size, power, out, done = points.astype(np.uint64), 1, np.array([_A]), None, 0
    while k:
        if k & 1:
            out = part[done : done + n].copy() if out is None else out * power + part[done : done + n]
            done += size
        k >>= 1
        if k:
            part = part[:-size] * power + part[size:]
            size, power = 2 * size, power * power | np.uint64(1)
    return out


_rooms: dict[int, np.ndarray] = {}


def _room(n: int) -> np.ndarray:
    """Memory for products, kept between texts."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _rooms:
        _rooms[size] = np.empty(size, np.uint32)
    return _rooms[size]


@cache
def _factors(n: int) -> np.ndarray:
    """Odd 32-bit factors, one for each permutation."""
    return (_mixed(np.arange(1, n + 1, dtype=np.uint64) * _A) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketch(points: np.ndarray, k: int = K, slots: int = SLOTS, tuple_size: int = TUPLE, some: int = 2048) -> np.ndarray:
    """16 bits for each position; all 0 without k-mers.

    ``some``: k-mers looked at in one go; the least of all are the least of the least of each part.
    """
    if not len(points):
        return np.zeros(slots, np.uint16)
    with np.errstate(over="ignore"):
        h = _kmers(points, min(k, len(points)))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            inner = np.zeros(len(h) + 1, bool)
            inner[1:-1] = same
            at = np.flatnonzero(inner[1:] | inner[:-1])  # of k-mers that occur twice or more
            run = np.cumsum(~inner[:-1][at])
            place = (np.sort(run.astype(np.uint64) << np.uint64(32) | order[at].astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            starts = np.flatnonzero(np.diff(run, prepend=0))
            h[place] += (np.arange(len(at)) - starts[run - 1]).astype(np.uint64) * _B
        h = _mixed(h)
        short = (h >> np.uint64(32)).astype(np.uint32)
        factors, rows, room = _factors(slots)[:, None], np.arange(slots), _room(slots * min(some, len(h)))
        value, place = np.empty((slots, 0), np.uint32), np.empty((slots, 0), np.int64)
        for a in range(0, len(h), some):
            own = short[None, a : a + some]
            part = np.multiply(own, factors, out=room[: slots * own.shape[1]].reshape(slots, -1))
            for _ in range(min(tuple_size, part.shape[1])):
                least = part.argmin(axis=1)  # of equals the first in the text
                value, place = np.column_stack((value, part[rows, least])), np.column_stack((place, a + least))
                part[rows, least] = np.iinfo(np.uint32).max
        if place.shape[1] > tuple_size:
            kept = np.argsort(value, axis=1, kind="stable")[:, :tuple_size]
            place = np.take_along_axis(place, kept, 1)
        place.sort(axis=1)
        mixed = np.zeros(slots, np.uint64)
        for j in range(place.shape[1]):
            mixed = _mixed(mixed * _B + h[place[:, j]] + np.uint64(j + 1))
    return np.maximum(mixed & np.uint64(0xFFFF), 1).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def with_next(docs: DataFrame, ident: str, text: str, found: Callable, schema: str, per_range: int = 1000) -> DataFrame:
    """``found(id, text, sketch, next text, next sketch)`` of each row and the next in descending order of ids."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids = rows.select("doc_id")
    n_ranges = min(max(10_000, 8 * parts(docs)), max(1, ceil(ids.count() / per_range)))  # several for each shuffle partition
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n_ranges for k in range(1, n_ranges)] or [0.5], 100_000)).first()[0] or []
    ranged = _ranges(rows, cuts)
    tops = {r["range"]: r.top for r in _ranges(ids, cuts).groupBy("range").agg(F.max("doc_id").alias("top")).collect()}  # n_ranges rows at most
    order = sorted(tops, reverse=True)
    before = [(r, tops[r], order[k - 1]) for k, r in enumerate(order)]  # the first goes behind the last
    halo = docs.sparkSession.createDataFrame(before, "range int, top long, before int")
    rows = ranged.join(F.broadcast(halo), "range")
    own = F.struct("range", F.lit(0).alias("copy"))
    both = F.array(own, F.struct(F.col("before").alias("range"), F.lit(1).alias("copy")))
    rows = rows.select("doc_id", "t", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), both).otherwise(F.array(own))).alias("at"))
    rows = rows.select(F.col("at.range").alias("range"), F.col("at.copy").alias("copy"), "doc_id", "t")
    rows = rows.repartition(parts(docs), "range").sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "t")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, (None, None)
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                at, copy, ident, t = (c[k].as_py() for c in batch.columns)
                if held and held[0] != at:
                    held = None
                if copy and not held:
                    continue  # a further row of the same top id
                if t != last[0]:
                    last = (t, sketch(_points(t)))
                s = last[1]
                if held:
                    out.append(found(*held[1:], t, s))
                held = None if copy else (at, ident, t, s)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(task, schema)


def _ranges(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """``rows`` with the number of their doc_id's range; null ids are in the lowest."""
    from pyspark.ml.feature import Bucketizer

    splits = [-inf, *sorted({float(c) for c in cuts}), inf]
    if len(splits) == 2:
        return rows.withColumn("range", F.lit(0))
    value = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-inf)))
    return Bucketizer(splits=splits, inputCol="_id", outputCol="_range").transform(value).withColumn("range", F.col("_range").cast("int")).drop("_id", "_range")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _found(ident, t: str, s: np.ndarray, following: str, s_next: np.ndarray) -> dict:
    e = edited(t, following)
    s_e = sketch(_points(e))
    return {
        "doc_id": ident, "n_chars": len(t), "edited_sha256": sha256(e.encode()).hexdigest(), "fingerprint": s.tobytes().hex(), "edited_fingerprint": s_e.tobytes().hex(),
        "near_edited": likeness(s, s_e), "near_next": likeness(s, s_next),
    }


def fingerprint_edits(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document."""
    return with_next(docs, ident, text, _found, FINGERPRINTS)


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row, without shuffle."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(_points(t.as_py())).tobytes().hex() for t in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(task, "doc_id long, fingerprint string")
