"""SimHash near-duplicates by pigeonring filtering (operator 4).

A fingerprint has 64 bits by majority over hashed word shingles. Two fingerprints within 3
bits are linked. Their 64 bits are a ring of 4 segments: if 3 bits differ at most, some
segment starts a chain whose first 1, 2, 3 and 4 segments differ by at most 0, 1, 2 and 3
bits. The first segment is equal then, and of the next one's halves one is equal, which
makes 8 join keys of 24 bits. Within a key's rows the chain prunes before the full check.

Only distinct fingerprints are compared. Keys of more than ``block`` fingerprints are split
into blocks and each pair of blocks is a unit of its own, so that no key needs one task and
none is cut off; a unit emits the edges of a spanning forest, fewer than its fingerprints,
never all pairs. Components follow by distributed stars.

Null or empty texts have fingerprint zero and are linked like any other. Repeated rows keep
one row each. Null ids have a fingerprint but never name a component unless all ids in it are
null. Extra columns are ignored; an empty table gives an empty table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.work import parts, written

BITS = 3
SEGMENTS = 4
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 16384):
        counts += np.unpackbits(h[k : k + 16384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Of UTF-8 text: bits set in over half the XXH64 (seed 42) of its shingles, unsigned."""
    from xxhash import xxh64_intdigest

    found = text.translate(LOWER).split()  # splits at space and code points 9 to 13
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    return majority(h)


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(task, "doc_id long, fp long")


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, 16 * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def _near(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of differences and the segment their chain starts at: the chain's budgets hold, and so the whole."""
    ok = np.ones(x.shape, bool)
    spent = np.zeros(x.shape, np.uint8)
    for step in range(SEGMENTS):
        shift = np.uint64(16) * ((start + step) % SEGMENTS).astype(np.uint64)
        spent += np.bitwise_count((x >> shift) & np.uint64(0xFFFF))
        ok &= spent <= (step + 1) * BITS // SEGMENTS
    return ok


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Spanning edges between fingerprints linked by chains from segment ``start``."""
    m = len(fps)
    if m == 2:
        return [(0, 1)] if _near(fps[:1] ^ fps[1:], np.array([start]))[0] else []
    near = np.empty((m, m), bool)
    for k in range(0, m, 512):
        near[k : k + 512] = _near(fps[k : k + 512, None] ^ fps[None], np.array([[start]]))
    new, out = np.ones(m, bool), []
    for root in range(m):
        if new[root]:
            new[root] = False
            front = np.array([root])
            while len(front):
                reached = near[front].any(axis=0) & new
                new &= ~reached
                front = np.flatnonzero(reached)
                out += [(root, int(x)) for x in front]
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each unit, from rows sorted by unit."""

    def edges(unit: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
        bounds = np.concatenate(([0], cut, [len(fps)]))
        out = []
        for k in np.flatnonzero(np.diff(bounds) > 1):
            own = np.unique(fps[bounds[k] : bounds[k + 1]])
            out += [(own[a], own[b]) for a, b in forest(own, int(unit[bounds[k], 0] >> 25))]
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    unit, fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        unit = np.concatenate((unit, np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)))
        fps = np.concatenate((fps, batch.column(3).to_numpy().view(np.uint64)))
        if len(fps) and (done := int(np.flatnonzero((unit == unit[-1]).all(axis=1))[0])):  # the last unit may go on
            yield edges(unit[:done], fps[:done])
            unit, fps = unit[done:], fps[done:]
    if len(fps):
        yield edges(unit, fps)


def links(fps: DataFrame, block: int = 2048) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of column ``fp`` like all links within 3 bits do."""
    fp = F.col("fp")
    keys = [
        F.lit((2 * i + half) << 24).bitwiseOR(F.shiftleft(_segment(fp, i), 8)).bitwiseOR(F.shiftright(_segment(fp, i + 1), 8 * half).bitwiseAND(F.lit(0xFF)))
        for i in range(SEGMENTS) for half in range(2)
    ]
    rows = fps.select("fp").distinct().select(F.explode(F.array(*keys)).alias("key"), "fp")
    hot = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")).where("blocks > 1")
    rows = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    rows = rows.withColumn("own", own).select("key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    units = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    return units.repartition(parts(fps), "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable by links) of each row."""
    fps = written(fingerprints(docs, ident, text), "fingerprints")
    roots = components(links(fps))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(ids, "root").select("fp", "component_id"), "fp")
