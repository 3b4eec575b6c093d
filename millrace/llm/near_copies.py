"""Near copies by SimHash, for texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints go through operator 4's join (``simhash.links``: pigeonring chains, 3 bits); each goes with the least
that it is linked to, and texts of one fingerprint with the least of them.

At 0.8 two 64-bit fingerprints differ by about 10 bits and often by 15, which leaves no segment of them
selective as a join key, in operator 4's way or any other. For the links that its 3 bits leave out, candidates are documents that agree in
one of ``BANDS`` keys of ``ROWS`` minimum hashes each; a pair at 0.8 has no key in common in 3 of a million
cases. Of a key's documents, those whose sizes and fingerprints allow 0.8 (at most ``BITS`` bits differ,
five deviations) are tried. Candidates of both kinds are verified by their exact shingles (64-bit hashes), and only links that hold and
join what is not yet joined leave the task: fewer than its documents, never all pairs.

Equal shingle sets are one node, whose shingles are sent once to each key that it shares with others; of keys
that the same nodes share, to the first. A pair is tried in the first of its common keys only. Keys of more than ``block`` bytes of shingles are split in
pairs of blocks as in ``simhash``, so no key needs one task and none is cut off.

Texts of fewer than five words are one shingle; texts without words are equal to each other. Null text:
empty. Rows without id take part like others; they name a class last. Repeated rows are one. Empty
table: empty result. Extra columns are ignored by ``near_copies`` and kept by ``distinct_texts``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.components import components
from millrace.llm.simhash import majority
from millrace.llm.word_hash import shingles, words
from millrace.llm.work import parts, written

SHINGLE, BANDS, ROWS, BITS = 5, 32, 5, 25
MINIMA = BANDS * ROWS
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = (np.random.default_rng(42).integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(shingles(words(text), SHINGLE))


def node(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.astype("<u8").tobytes())).view(np.int64))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: its minimum hashes under permutations of their own, mixed."""
    low = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 1024):
        np.minimum(low, (short[None, k : k + 1024] * _FACTORS).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = (key * _A) ^ low[k::ROWS]
            key = (key ^ (key >> np.uint64(31))) * _B
    return key.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """row, doc_id, node, size of the shingles, fingerprint and keys of each row; no keys without words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py()) for t in batch.column(2)]
            keys = [bands(x) if len(x) else np.zeros(0, np.int64) for x in found]
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            fps = np.fromiter((majority(x) for x in found), np.uint64, len(found)).view(np.int64)
            cols = [pa.array([node(x) for x in found], pa.int64()), pa.array([8 * len(x) for x in found], pa.int64()), pa.array(fps), keys]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["row", "doc_id", "node", "size", "fp", "keys"])

    return docs.mapInArrow(task, "row long, doc_id long, node long, size long, fp long, keys array<long>")


def linked(sets: list[np.ndarray], fps: np.ndarray, tags: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Links that hold among sets with a common key of ``band``: a spanning forest of the pairs whose first common key it is.

    ``tags``: 32 bits of each set's keys by band. Sets of band ``BANDS`` come from operator 4's join: pairs within its bits are tried.
    """
    bits = BITS if band < BANDS else simhash.BITS
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    both, ends, out, rest = None, np.cumsum(size), [], np.arange(len(sets))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            may = (5 * np.minimum(size[rest], size[x]) >= 4 * np.maximum(size[rest], size[x])) & (np.bitwise_count(fps[rest] ^ fps[x]) <= bits)
            if band < BANDS:
                may[may] = (tags[rest[may]] == tags[x]).argmax(axis=1) == band
            tried = rest[may]
            if not len(tried):
                continue
            if len(sets) <= 4:
                common = np.fromiter((len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in tried.tolist()), np.int64, len(tried))
            else:
                if both is None:
                    kinds, both = np.unique(np.concatenate(sets), return_inverse=True)
                    mark = np.zeros(len(kinds), np.int8)
                mark[both[ends[x] - size[x] : ends[x]]] = 1
                n = size[tried]
                at = np.repeat(ends[tried] - np.cumsum(n), n) + np.arange(n.sum())
                common = np.add.reduceat(mark[both[at]], np.cumsum(n) - n, dtype=np.int64)
                mark[both[ends[x] - size[x] : ends[x]]] = 0
            hits = tried[5 * common >= 4 * (size[x] + size[tried] - common)]
            out += [(x, y) for y in hits.tolist()]
            todo += hits.tolist()
            rest = np.setdiff1d(rest, hits, assume_unique=True)
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each unit, from rows sorted by unit."""

    def links(unit: tuple, held: dict[int, tuple]) -> pa.RecordBatch:
        ids = np.array(sorted(held), np.int64)
        own = [held[i] for i in ids.tolist()]
        tags = np.stack([np.frombuffer(o[1], "<u4") for o in own])
        found = linked([np.frombuffer(o[2], "<u8") for o in own], np.array([o[0] for o in own], np.int64).view(np.uint64), tags, unit[3])
        found = ids[np.array(found, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1, initial=2**63 - 1)), pa.array(found.max(axis=1, initial=-(2**63)))], ["a", "b"])

    last, held = None, {}
    for batch in batches:
        for unit, at, fp, tags, shingles in zip(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True), *(batch.column(k).to_pylist() for k in range(4, 8)), strict=True):
            if unit != last:
                if len(held) > 1:
                    yield links(last, held)
                last, held = unit, {}
            held[at] = (fp, tags, shingles)
    if len(held) > 1:
        yield links(last, held)


def _chained(nodes: DataFrame, block: int) -> DataFrame:
    """node and unit of what operator 4's join brings together: each fingerprint with the least that it is linked to.

    A unit is the first node of a fingerprint and a part, by bytes of shingles, of those that go with it.
    """
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    near = simhash.links(nodes).groupBy(F.greatest("a", "b").alias("fp")).agg(F.min(F.least("a", "b")).alias("to"))
    hub = F.when(F.col("node") == F.col("head"), F.col("to")).otherwise(F.col("fp"))
    leaves = nodes.select("node", "size", "fp").join(heads.join(near, "fp", "left"), "fp").select("node", "size", hub.alias("hub")).where("hub IS NOT NULL")
    leaves = written(leaves, "chained")
    hubs = leaves.groupBy("hub").agg(F.ceil(F.sum("size") / block).cast("int").alias("parts"))
    unit = F.struct(F.col("hub").alias("key"), F.col("part").alias("low"), F.col("part").alias("high"), F.lit(BANDS).alias("band")).alias("unit")
    own = leaves.join(hubs, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    first = hubs.join(heads, F.col("hub") == F.col("fp")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return own.select("node", unit).unionByName(first.select(F.col("head").alias("node"), unit))


def _links(docs: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between nodes that reach 0.8 and connect all that do."""
    nodes = written(rows.where("size > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    keys = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    several = keys.groupBy("key").agg(F.first("band").alias("band"), F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    # keys of the same documents are one: that of the first band, where all their pairs are tried
    several = several.groupBy("n", "members").agg(F.min(F.struct("band", "key", "size")).alias("k")).select("k.key", F.ceil(F.col("k.size") / block).cast("int").alias("blocks"))
    shared = keys.select("node", "band", "key").join(several, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    shared = shared.select("node", "key", "band", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    unit = F.struct("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "band").alias("unit")
    units = shared.select("node", unit).unionByName(_chained(nodes, block)).groupBy("node").agg(F.collect_list("unit").alias("units"))  # as many as a node's keys have blocks

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            first = []
            for k, at in enumerate(batch.column(0).to_pylist()):
                if at not in done:  # repeated rows once
                    done.add(at)
                    first.append(k)
            batch = batch.take(pa.array(first, pa.int64()))
            found = [shingle_set(t.as_py()) for t in batch.column(1)]
            tags = [np.array(x.as_py(), np.int64).astype("<u4").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(tags, pa.binary()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary()), batch.column(3)], ["node", "fp", "tags", "shingles", "units"])

    asked = nodes.select("node", "row", "keys", "fp").join(units, "node")
    unit = "array<struct<key:long,low:int,high:int,band:int>>"
    sent = docs.select("row", "t").join(asked, "row").select("node", "t", "keys", "units", "fp").mapInArrow(task, f"node long, fp long, tags binary, shingles binary, units {unit}")
    sent = sent.select(F.explode("units").alias("u"), "node", "fp", "tags", "shingles").select("u.key", "u.low", "u.high", "u.band", "node", "fp", "tags", "shingles")
    return sent.repartition(parts(docs), "key", "low", "high").sortWithinPartitions("key", "low", "high", "band").mapInArrow(_units, "a long, b long").distinct()


def _classes(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, node), and for each node its class: component_id and the first row of it."""
    rows = written(_keyed(docs), "keys")
    roots = components(_links(docs, rows, block))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    named = rows.groupBy("node").agg(least.alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = written(named, "roots")
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    return rows, named.select("node", "root").join(first.select("root", "first.doc_id", "first.row"), "root").select("node", F.col("doc_id").alias("component_id"), F.col("row").alias("first"))


def _rows(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(ident, text).alias("row"), F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))


def near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", block: int = 4 << 20) -> DataFrame:
    """doc_id and component_id of each row: the smallest id reachable by links of 0.8 or more, null if none has an id."""
    rows, classes = _classes(_rows(docs, ident, text), block)
    return rows.select("doc_id", "node").join(classes.select("node", "component_id"), "node").select("doc_id", "component_id")


def distinct_texts(docs: DataFrame, ident: str = "doc_id", text: str = "text", block: int = 4 << 20) -> DataFrame:
    """Of each class the row of the smallest id; of its rows with that id and one text the least."""
    _, classes = _classes(_rows(docs, ident, text), block)
    keyed = docs.withColumn("_row", F.xxhash64(ident, text)).join(classes.select(F.col("first").alias("_row")).distinct(), "_row", "left_semi")
    rows = keyed.groupBy("_row").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_it"))
    return rows.select("_it.*")
